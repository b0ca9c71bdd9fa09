"""partnerlens: channel-partner sales analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    readers, writers, driver-table bindings, list-column parsing
functions  scalar column expressions (pure ``Column -> Column`` helpers)
operators  reusable DataFrame -> DataFrame building blocks (cleaning,
           reshaping, splits, ranking, similarity kernels)
plans      end-to-end jobs (discount, recommenders, schemes, evaluation,
           explanation, sentiment) and the query registry
llm        operators for training corpora; nothing else imports it
"""

__all__ = ["session"]

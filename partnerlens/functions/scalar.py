"""Scalar column expressions.

Each helper maps columns to a column; nothing here triggers a job.  All are
built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's for equal results.
DEFAULT_ELASTICITY = -0.2          # used when elasticity is missing
DISCOUNT_MIN, DISCOUNT_MAX = 0, 50  # discount clip range, percent
DISCOUNT_STEP = 5                   # scenario step, percent
N_PRICE_BUCKETS = 4                 # equal-width price buckets
PAD_NO_SCHEME = "No Scheme"
PAD_NO_SCHEME_AVAILABLE = "No Scheme Available"
FILL_NOT_AVAILABLE = "Not Available"
POSITIVE, NEGATIVE = "Positive", "Negative"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def fn_log1p(c: str | Column) -> Column:
    return F.log1p(col(c))


def fn_exp_inverse(c: str | Column, parity: bool = False) -> Column:
    """Back-transform of ``log1p``: ``expm1``; ``parity=True`` uses ``exp``
    as the reference does (every value one too high)."""
    return F.exp(col(c)) if parity else F.expm1(col(c))


def fn_engagement(sales, feedback, growth) -> Column:
    return F.log1p(col(sales)) * (col(feedback) + col(growth))


def fn_engagement_geo(sales, feedback, dummies: list, weight: float = 5.0) -> Column:
    total = sum((col(d) for d in dummies), F.lit(0))
    return F.log1p(col(sales)) * (col(feedback) + F.lit(weight) * total)


def fn_engagement_dropped(sales, feedback, kept_dummies: list, variant: str = "additive",
                          weight: float = 1.0) -> Column:
    """Engagement with one dummy group dropped.  ``additive``: sales term
    times (feedback + w * sum of kept dummies); ``product``: sales term
    times feedback times sum of kept dummies (the stockist-dropped form)."""
    total = sum((col(d) for d in kept_dummies), F.lit(0))
    if variant == "product":
        return F.log1p(col(sales)) * col(feedback) * total
    return F.log1p(col(sales)) * (col(feedback) + F.lit(weight) * total)


def fn_month(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def fn_date_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def fn_clip(c, lo=DISCOUNT_MIN, hi=DISCOUNT_MAX) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def fn_default_elasticity(c, default: float = DEFAULT_ELASTICITY) -> Column:
    return F.coalesce(nan_to_null(c), F.lit(default))


def fn_demand_response(demand, elasticity, discount) -> Column:
    """demand * (1 - d/100) ** e, with d clipped to [0, 50] and a missing
    elasticity replaced by the default."""
    d = fn_clip(discount)
    return col(demand) * F.exp(fn_default_elasticity(elasticity) * F.log(1 - d / 100))


def fn_change_pct(new, old) -> Column:
    return F.try_divide(col(new) - col(old), col(old)) * 100


def fn_revenue(price, discount, demand) -> Column:
    return col(price) * (1 - col(discount) / 100) * col(demand)


def fn_round(c, n: int) -> Column:
    return F.round(col(c), n)


def fn_cents_text(c) -> Column:
    """Two-decimal text of a non-negative amount, built from integer cents
    so that it is identical in every engine (no printf rounding modes)."""
    cents = F.round(col(c) * 100).cast("bigint")
    return F.concat(F.floor(cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def fn_fixed_text(x, digits: int = 6) -> Column:
    """Fixed-decimal text of a double built from integer units, identical
    in every engine (no engine-specific float printing or rounding mode)."""
    x = col(x)
    scale = 10 ** digits
    m = F.round(F.abs(x) * scale).cast("bigint")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
                    F.floor(m / scale).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((m % scale).cast("string"), digits, "0"))


def fn_price_bucket_label(lo, hi) -> Column:
    return F.concat(fn_cents_text(lo), F.lit("-"), fn_cents_text(hi))


def fn_split_schemes(c, sep: str = ", ") -> Column:
    """'A, B' -> ['A', 'B']; NULL -> []."""
    return F.coalesce(F.split(col(c), sep), F.array().cast("array<string>"))


def fn_join_partners(ids_col) -> Column:
    """Aggregate: distinct ids joined with ', ' in ascending order."""
    return F.concat_ws(", ", F.array_sort(F.collect_set(col(ids_col).cast("string"))))


def fn_pad3(arr, pad: str | None) -> Column:
    """Three columns from a ranked array, padded with ``pad``."""
    a = col(arr)
    lit = F.lit(pad) if pad is not None else F.lit(None).cast("string")
    return [F.coalesce(F.try_element_at(a, F.lit(i)), lit) for i in (1, 2, 3)]


def fn_fill_na_literal(c, value: str = FILL_NOT_AVAILABLE) -> Column:
    return F.coalesce(col(c), F.lit(value))


def fn_label_threshold(p, threshold: float = 0.5) -> Column:
    return F.when(col(p) >= threshold, POSITIVE).otherwise(NEGATIVE)


def fn_label_class(c, positive_class: int = 2) -> Column:
    return F.when(col(c) == positive_class, POSITIVE).otherwise(NEGATIVE)


def fn_label_contains(reply) -> Column:
    return F.when(F.lower(F.trim(col(reply))).contains("positive"), POSITIVE).otherwise(NEGATIVE)


def fn_hash_pct(key, seed: int = 42) -> Column:
    """Deterministic 0..99 bucket of a key: the first 8 hex digits of
    md5('<seed>|<key>') read as an integer, modulo 100.  DuckDB computes
    the same value, so splits are repeatable by the oracle."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string"))), 1, 8), 16, 10)
    return (h.cast("bigint") % 100).cast("int")


def fn_hash_key(key, seed: int = 42) -> Column:
    """Deterministic non-negative 32-bit ordering key of a key (md5 based)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string"))), 1, 8), 16, 10)
    return h.cast("bigint")


def hash_pct_sql(key_sql: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}|' || CAST({key_sql} AS VARCHAR)), 1, 8)) AS BIGINT) % 100)"


def hash_key_sql(key_sql: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || CAST({key_sql} AS VARCHAR)), 1, 8)) AS BIGINT)"

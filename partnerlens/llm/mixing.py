"""Op 1: mixing sources to target weights by Pfair scheduling.

Time is a row of slots; each slot holds one block of rows of one source.  A
source with share w releases its k-th block at slot floor(k / w) with the
deadline ceil((k + 1) / w); the earliest deadline among the released blocks
goes first.  With shares that sum to one every block meets its window, so at
every slot each source has got its share to within less than one block.

Shares are ratios of whole numbers (quotas), so the schedule repeats after
sum(quotas) slots and only that many are ever worked out; the place of any
block follows by arithmetic, as a join of the rows with a small table.  When a
source runs out, the others go on in a new phase with their shares scaled up:
no row is dropped or repeated."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from partnerlens.llm.common import gapless_index, scratch

MAX_PERIOD = 100_000  # bound of the sum of quotas, hence of the plan that is broadcast (about 40 MB)
REST = "(rest)"  # rows of null or unlisted sources, as one source

ADDED = ["mix_source", "mix_phase", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"]


def hyperperiod(quotas: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """source -> [(slot, release, deadline)] of its blocks in one period of
    sum(quotas) slots, by earliest deadline first (ties by name)."""
    total = sum(quotas.values())
    jobs = sorted((k * total // q, -(-(k + 1) * total // q), s) for s, q in quotas.items() for k in range(q))
    out: dict[str, list] = {s: [] for s in quotas}
    ready: list[tuple[int, str, int]] = []
    j = 0
    for slot in range(total):
        while j < len(jobs) and jobs[j][0] <= slot:
            heapq.heappush(ready, (jobs[j][1], jobs[j][2], jobs[j][0]))
            j += 1
        due, source, release = heapq.heappop(ready)
        out[source].append((slot, release, due))
    return out


def phases(blocks: dict[str, int], quotas: dict[str, int]) -> list[dict]:
    """Rows (source, phase, k_from, k_to, base, period, quota, plan): blocks
    k_from <= k < k_to of a source are placed in this phase; the m-th of them
    sits at slot base + (m div quota) * period + plan[m mod quota]."""
    done = {s: 0 for s in blocks}
    base, phase, out = 0, 0, []
    active = {s: quotas[s] for s, n in blocks.items() if n > 0 and quotas.get(s, 0) > 0}
    while active:
        plan, period = hyperperiod(active), sum(active.values())

        def slot_of(s: str, m: int) -> int:
            return m // active[s] * period + plan[s][m % active[s]][0]

        # the phase ends at the first slot that would want a block a source no longer has
        end = min(slot_of(s, blocks[s] - done[s]) for s in active)
        for s, q in active.items():
            full, part = divmod(end, period)
            took = full * q + sum(1 for x in plan[s] if x[0] < part)
            if took:
                out.append({"source": s, "phase": phase, "k_from": done[s], "k_to": done[s] + took, "base": base,
                            "period": period, "quota": q, "plan": [list(x) for x in plan[s]]})
            done[s] += took
        base, phase = base + end, phase + 1
        active = {s: q for s, q in active.items() if done[s] < blocks[s]}
    return out


def mix(docs: DataFrame, targets: dict[str, int], rest: int = 1, block_rows: int = 64,
        source: str = "source", key: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with mix_source (its source, or ``(rest)``),
    mix_phase, mix_block, mix_slot, mix_release, mix_deadline and
    mix_position, by which the mixture is read in order.

    ``targets``: whole-number quotas of the listed sources, all positive; what
    is not listed (null included) shares the quota ``rest``.  Their sum, at
    most MAX_PERIOD, bounds all that the driver holds.  Rows of a source are
    taken in the order of a hash of their key; rows that repeat a key follow
    one another.  Texts of any length only travel with their rows.  Input
    columns may have any names: one that is called like a column added here
    comes back with ``c_`` before its name.  An empty table gives no rows."""
    spark = docs.sparkSession
    quotas = [*targets.values(), rest]
    if any(int(q) != q or q <= 0 for q in quotas) or sum(quotas) > MAX_PERIOD:
        raise ValueError(f"quotas must be positive whole numbers with a sum of at most {MAX_PERIOD}")
    name = F.col(f"`{source}`").cast("string")
    columns = [f"`{c}`" for c in docs.columns]
    # the row travels as one column, so that no name of its columns meets one used here
    rows = scratch(docs.select(F.struct(*columns).alias("row"), F.col(f"`{key}`").alias("key"),
                               F.when(name.isin(list(targets)), name).otherwise(F.lit(REST)).alias("mix_source")), "mix")
    tie = F.xxhash64(*[F.col(f"row.`{c}`") for c, t in docs.dtypes if "map<" not in t])
    placed = gapless_index(rows.withColumn("tie", tie), ["mix_source"], ["key", "tie"], "__i").drop("tie")
    counts = {r["mix_source"]: -(-r["count"] // block_rows) for r in rows.groupBy("mix_source").count().collect()}
    table = phases(counts, {**targets, REST: rest})
    steps = spark.createDataFrame(
        [(r["source"], r["phase"], r["k_from"], r["k_to"], r["base"], r["period"], r["quota"], r["plan"]) for r in table],
        "__s string, mix_phase int, __from long, __to long, __base long, __period long, __quota long, "
        "__plan array<array<long>>")
    block = F.floor(F.col("__i") / F.lit(block_rows)).cast("long")
    joined = placed.withColumn("mix_block", block).join(
        F.broadcast(steps), (F.col("mix_source") == F.col("__s")) & (F.col("mix_block") >= F.col("__from"))
        & (F.col("mix_block") < F.col("__to")))
    m = F.col("mix_block") - F.col("__from")
    at = F.element_at("__plan", (F.pmod(m, F.col("__quota")) + 1).cast("int"))
    turn = F.col("__base") + F.floor(m / F.col("__quota")).cast("long") * F.col("__period")
    out = (joined.withColumn("mix_slot", turn + at[0]).withColumn("mix_release", turn + at[1])
           .withColumn("mix_deadline", turn + at[2])
           .withColumn("mix_position", F.col("mix_slot") * F.lit(block_rows) + F.pmod(F.col("__i"), F.lit(block_rows))))
    kept, taken = [], {*ADDED, *(c.lower() for c in docs.columns)}
    for c in docs.columns:
        to = c
        while to.lower() in ADDED or (to != c and to.lower() in taken):
            to = "c_" + to
        kept.append(F.col(f"row.`{c}`").alias(to))
    return out.select(*kept, *ADDED)

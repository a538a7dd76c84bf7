"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; they share
``budget`` times all sizes, no target above ``cap`` times its source's size, the excess
reshared by weight until none is above.

Fitting, per source: every document is taken floor(target / source size) times, and the
remaining budget is fitted by a subset of documents taken once more. Documents are counted
by exact size; the same share of every size is taken, and what the rounding leaves over is
fitted by a bounded-knapsack dynamic programme over the sizes' remaining counts. Which
documents of a size are taken follows a seeded hash of the id.

Scale: only (source, size) counts reach the fitting, one source per task, each source's
histogram having as many rows as it has distinct sizes. Documents of a size are chosen by
hash bucket: whole buckets below the cut, and only the bucket at the cut is ranked, so a hot
(source, size) group is never sorted in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.keys import sequence_within
from sluice.session import pin

WEIGHTS = (5, 2, 1)
DP_WORDS = 1 << 15
BUCKET_BITS = 12


def word_count(text: str = "text"):
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null has none."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def fit_counts(sizes: list[int], counts: list[int], budget: int, dp_words: int = DP_WORDS) -> list[int]:
    """How many documents of each size to take so that their sum comes as near to ``budget``
    as this fitting finds, from below or from above. First an equal share of every size is
    taken and only what it leaves is fitted; if that misses the budget, the share is taken of
    ``dp_words`` less (of nothing, for a budget up to that: the fit is then exact)."""
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(sizes)
    if budget >= total:
        return [n if s else 0 for s, n in zip(sizes, counts, strict=True)]
    miss = lambda take: abs(sum(s * k for s, k in zip(sizes, take, strict=True)) - budget)
    take = _fit_rest(sizes, counts, budget, budget, total, dp_words)
    if not miss(take):
        return take
    return min(take, _fit_rest(sizes, counts, budget, max(0, budget - dp_words), total, dp_words), key=miss)


def _fit_rest(sizes: list[int], counts: list[int], budget: int, shared: int, total: int, dp_words: int) -> list[int]:
    """An equal share of every size for ``shared`` words, the largest sizes while more than
    ``dp_words`` are left, and an exact bounded knapsack over the rest, read on both sides of
    the budget (ties: below)."""
    take = [n * shared // total if s else 0 for s, n in zip(sizes, counts, strict=True)]
    left = budget - sum(s * k for s, k in zip(sizes, take, strict=True))
    order = sorted((i for i, s in enumerate(sizes) if s), key=lambda i: -sizes[i])
    for i in order:
        if left <= dp_words:
            break
        k = min(counts[i] - take[i], (left - dp_words // 2) // sizes[i])
        if k > 0:
            take[i] += k
            left -= k * sizes[i]
    goal = left
    # a sum above twice the goal is further off than taking nothing more
    mask, reach, steps = (1 << (2 * goal + 1)) - 1, 1, []
    for i in order:
        spare = min(counts[i] - take[i], 2 * goal // sizes[i])
        if spare <= 0:
            continue
        steps.append((i, spare, reach))
        part = 1
        while spare > 0:  # binary splitting: every number of copies up to spare
            k = min(part, spare)
            reach |= (reach << (k * sizes[i])) & mask
            spare -= k
            part *= 2
        if reach >> goal & 1:
            break
    at = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> goal
    if above:
        over = (above & -above).bit_length() - 1
        at = goal + over if over < goal - at else at
    for i, spare, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at -= sizes[i]
            k += 1
        take[i] += k
    return take


def targets(sizes: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    seq = sequence_within(per, [F.col("none"), F.col("source")], None, name="nth")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = pin(seq.select("source", "source_size", w.alias("weight")), "sources")
    goal = budget * (src.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    limit = F.lit(cap) * F.col("source_size")
    while True:
        free = F.col("weight") * F.lit(rate) < limit
        row = src.agg(
            F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, limit)).alias("capped"),
        ).first()
        if not row.w:
            break
        new = (goal - (row.capped or 0.0)) / row.w
        if new <= rate:
            break
        rate = new
    return src.select("source", "source_size", F.least(F.col("weight") * F.lit(rate), limit).alias("target"))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable")
    whole, goal = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    base = int(goal // whole) if whole else 0
    more = fit_counts([int(x) for x in rows["size"]], [int(x) for x in rows["n"]], round(goal - base * whole))
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "base": base, "extra": more})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of ``docs``: id, size (words), source_size, target of its source,
    taken (words the mix takes, repeats counted: 0, 1 or 2 times the size).

    Null text has size 0 and is never taken; null sources are one source, ordered last. A
    source without words has target 0. Ties of the seeded hash (repeated ids) are ranked
    arbitrarily but alike rows are interchangeable, so the result is the same. The choice
    depends only on ids, sources, sizes and ``seed``. Extra columns are not read."""
    rank = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    d = pin(d.withColumn("r", rank).withColumn("b", F.shiftrightunsigned("r", 64 - BUCKET_BITS)), "sizes")
    goal = pin(targets(d.select("source", "size"), budget, cap, weights), "targets")
    g = goal.withColumnRenamed("source", "g_source")
    binned = d.groupBy("source", "size", "b").agg(F.count(F.lit(1)).alias("nb"))
    hist = binned.groupBy("source", "size").agg(F.sum("nb").alias("n"))
    hist = hist.join(g, F.col("source").eqNullSafe(F.col("g_source"))).select("source", "size", "n", "source_size", "target")
    plan = hist.groupBy("source").applyInPandas(_fit, "source string, size long, base long, extra long")
    plan = pin(plan, "plan").withColumnsRenamed({"source": "p_source", "size": "p_size"})
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    # the bucket in which a size's last taken document lies: at most 2**BUCKET_BITS rows a window
    upto = Window.partitionBy("source", "size").orderBy("b")
    before = F.sum("nb").over(upto) - F.col("nb")
    cut = binned.join(plan.where("extra > 0"), same).withColumn("before", before)
    cut = cut.where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("nb") >= F.col("extra")))
    cut = cut.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("b").alias("cut"), (F.col("extra") - F.col("before")).alias("rest"))
    plan = plan.join(cut, F.col("p_source").eqNullSafe(F.col("c_source")) & (F.col("p_size") == F.col("c_size")), "left")
    plan = plan.select("p_source", "p_size", "base", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("rest", F.lit(0)).alias("rest"))
    # pinned, so that the join below has exchanges of its own and a hot size can be split
    plan = pin(plan.join(g, F.col("p_source").eqNullSafe(F.col("g_source"))).drop("g_source"), "plan-by-size")
    marked = pin(d.join(plan, same).drop("p_source", "p_size"), "marked")
    cols = ["id", "size", "source_size", "target", "base"]
    sure = marked.where("b <> cut").select(*cols, F.when(F.col("b") < F.col("cut"), 1).otherwise(0).alias("more"))
    edge = marked.where("b = cut")
    nth = F.row_number().over(Window.partitionBy("source", "size").orderBy("r", "id"))
    edge = edge.select(*cols, F.when(nth <= F.col("rest"), 1).otherwise(0).alias("more"))
    out = sure.unionByName(edge)
    return out.select(
        F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * (F.col("base") + F.col("more"))).alias("taken"))

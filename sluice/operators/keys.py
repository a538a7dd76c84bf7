"""Ordered numbering and keys: D12 sequential ids, D13 time-ordered ids, plus the
skew-safe position/neighbour primitives the other operators build on.

A global ``row_number()`` window moves every row into one task, and a window partitioned
by a hot group moves that whole group into one task. ``sequence_within`` avoids both: it
range-partitions on (group, order) so a hot group is spread over many tasks, numbers rows
inside each task, then adds the counts of earlier tasks for the same group. Only the small
per-(task, group) count table is windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.exprs import epoch_millis
from sluice.session import pin

_LOCAL_BITS = 33  # monotonically_increasing_id packs (partition << 33) + row index


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


PID, POS = "_sl_pid", "_sl_pos"


def ordered_slices(df: DataFrame, order: list, group: list[str]) -> DataFrame:
    """The layout every skew-safe ordered operator shares: rows range-partitioned and
    sorted on (group, order), so one hot group is spread over many tasks, with the task id
    (``_sl_pid``) and the position inside the task (``_sl_pos``) pinned by a written
    table in the shared checkpoint folder. A (task, group) pair is a *slice*; a group's slices are contiguous and in
    task order, so per-slice summaries windowed over the group give each slice its carry-in.
    """
    sort_keys = [F.col(g) for g in group] + [_as_col(o) for o in order]
    ranked = df.orderBy(*sort_keys).withColumn("_sl_mid", F.monotonically_increasing_id())
    # The ids depend on task layout; pin them (a written table in the shared checkpoint
    # folder) before anything reads them twice.
    ranked = pin(ranked, "slices")
    return ranked.withColumns({
        PID: F.shiftright("_sl_mid", _LOCAL_BITS),
        POS: F.col("_sl_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
    }).drop("_sl_mid")


def earlier_slices(group: list[str]):
    """Window over a group's slice summaries: all slices in earlier tasks."""
    return Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)


def in_slice(group: list[str]):
    """Window over the rows of one slice, up to the current row."""
    return Window.partitionBy(PID, *group).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)


def earlier_rows(ranked: DataFrame) -> DataFrame:
    """(task id, rows in earlier tasks): with the position inside the task a row's place in
    the whole order. One row per task."""
    per = ranked.groupBy(PID).agg(F.count(F.lit(1)).alias("_er_n"))
    return per.select(PID, F.coalesce(F.sum("_er_n").over(earlier_slices([])), F.lit(0)).alias("_er_before"))


def join_slice_stats(ranked: DataFrame, stats: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Attach per-slice columns ``cols`` of ``stats`` (one row per slice) to its rows. The
    stats table has at most (groups + tasks) rows; AQE broadcasts it when it is small and
    otherwise shuffles on (task, group), which no hot group can skew."""
    s = stats.select(F.col(PID).alias("_sj_pid"), *[F.col(g).alias(f"_sj_g_{i}") for i, g in enumerate(group)], *cols)
    cond = ranked[PID] == s["_sj_pid"]
    for i, g in enumerate(group):
        cond = cond & ranked[g].eqNullSafe(s[f"_sj_g_{i}"])
    return ranked.join(s, cond, "inner").drop("_sj_pid", *[f"_sj_g_{i}" for i in range(len(group))])


def sequence_within(df: DataFrame, order: list, group: list[str] | None = None, name: str = "seq",
                    sums: dict[str, Column] | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its ``group`` under ``order``.

    ``order`` (names or Columns, ``.desc()`` allowed) must make the order total, otherwise
    ties are numbered in arrival order. NULL group values form their own group.

    ``sums`` (output name -> numeric column) adds, in the same sorted pass, the sum of that
    column over the group's *earlier* rows (an exclusive prefix sum), e.g. the offset at
    which a row's children start when each row owns a variable number of them.
    """
    group = list(group or [])
    sums = dict(sums or {})
    src = df.withColumns({f"_sq_v_{i}": F.coalesce(c, F.lit(0)).cast("long") for i, c in enumerate(sums.values())}) if sums else df
    ranked = ordered_slices(src, order, group)
    vals = [f"_sq_v_{i}" for i in range(len(sums))]
    stats = ranked.groupBy(PID, *group).agg(F.min(POS).alias("_sq_first"), F.count(F.lit(1)).alias("_sq_n"),
                                            *[F.sum(v).alias(f"{v}_part") for v in vals])
    stats = stats.withColumn("_sq_before", F.coalesce(F.sum("_sq_n").over(earlier_slices(group)), F.lit(0)))
    for v in vals:
        stats = stats.withColumn(f"{v}_carry", F.coalesce(F.sum(f"{v}_part").over(earlier_slices(group)), F.lit(0)))
    if vals:
        ranked = ranked.withColumns({f"{v}_loc": F.sum(v).over(in_slice(group)) - F.col(v) for v in vals})
    out = join_slice_stats(ranked, stats, group, ["_sq_first", "_sq_before", *[f"{v}_carry" for v in vals]])
    out = out.withColumn(name, (F.col(POS) - F.col("_sq_first") + F.col("_sq_before") + F.lit(1)).cast("long"))
    out = out.withColumns({n: (F.col(f"{v}_loc") + F.col(f"{v}_carry")).cast("long") for n, v in zip(sums, vals)})
    return out.drop(PID, POS, "_sq_first", "_sq_before", *vals, *[f"{v}_loc" for v in vals], *[f"{v}_carry" for v in vals])


_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


def running_within(df: DataFrame, order: list, group: list[str], value, how: str = "sum", name: str = "running") -> DataFrame:
    """Add ``name`` = running ``how`` (sum, max, min) of ``value`` over the rows of each
    group up to and including the current one, in ``order`` (which must be total).

    Running aggregate inside each slice (a window on (task, group): the hash exchange it
    needs spreads a hot group by task), plus the carry-in from the group's earlier slices.
    """
    agg = _RUNNING[how]
    group = list(group)
    val = value if isinstance(value, Column) else F.col(value)
    ranked = ordered_slices(df.withColumn("_rw_v", val), order, group)
    ranked = ranked.withColumn("_rw_local", agg("_rw_v").over(in_slice(group)))
    stats = ranked.groupBy(PID, *group).agg(agg("_rw_v").alias("_rw_part"))
    stats = stats.withColumn("_rw_carry", agg("_rw_part").over(earlier_slices(group)))
    out = join_slice_stats(ranked, stats, group, ["_rw_carry"])
    combined = (F.coalesce(F.col("_rw_local"), F.lit(0)) + F.coalesce(F.col("_rw_carry"), F.lit(0))
                if how == "sum" else (F.greatest if how == "max" else F.least)(F.col("_rw_local"), F.col("_rw_carry")))
    return out.withColumn(name, combined).drop("_rw_v", PID, POS, "_rw_local", "_rw_carry")


def lag_within(df: DataFrame, order: list, group: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prefix+col`` = value of ``col`` on the previous row of the same group, NULL on
    its first row. ``order`` must be total.

    Inside a slice the neighbour is a window value (the exchange on (task, group) spreads a
    hot group by task). The first row of a slice takes the last row of the group's slice
    before it: one row per slice, so no row is joined to the table itself.
    """
    group = list(group)
    ranked = ordered_slices(df, order, group)
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    here = Window.partitionBy(PID, *group).orderBy(POS)
    last = ranked.groupBy(PID, *group).agg(F.max_by(row, POS).alias("_lag_last"))
    last = last.withColumn("_lag_carry", F.lag("_lag_last").over(Window.partitionBy(*group).orderBy(PID)))
    out = ranked.withColumn("_lag_here", F.lag(row).over(here))
    out = join_slice_stats(out, last, group, ["_lag_carry"])
    prev = F.coalesce("_lag_here", "_lag_carry")  # a row before it is a struct, never NULL
    return out.withColumns({prefix + c: prev[f"c{i}"] for i, c in enumerate(cols)}).drop(PID, POS, "_lag_here", "_lag_carry")


def next_id_base(existing: DataFrame, id_col: str) -> Column:
    """max(existing id, 0) as a scalar subquery (planned once, no join)."""
    return existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()


def assign_sequential_ids(new_rows: DataFrame, existing: DataFrame | None, id_col: str, order: list) -> DataFrame:
    """New rows get max(existing, 0)+1, +2, ... in ``order``; an empty table starts at 1."""
    base = next_id_base(existing, id_col) if existing is not None else F.lit(0).cast("long")
    seq = sequence_within(new_rows, order, None, name="_id_seq")
    return seq.withColumn(id_col, (base + F.col("_id_seq")).cast("long")).drop("_id_seq")


def time_ordered_ids(df: DataFrame, ts_col: str, seq_col: str, name: str = "snowflake_id") -> DataFrame:
    """(epoch ms << 22) OR (low 22 bits of ``seq_col``); repeatable for the same input."""
    millis = epoch_millis(ts_col, df.schema[ts_col].dataType)
    low = F.col(seq_col).cast("long").bitwiseAND(F.lit(0x3FFFFF))
    return df.withColumn(name, F.shiftleft(millis, 22).bitwiseOR(low))

"""Operations over the run audit and configs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.exprs import decode_json_list
from sluice.operators.keys import lag_within
from sluice.operators.mutate import ts_literal
from sluice.operators.reads import active


def elapsed_seconds(start: str = "start_time", end: str = "end_time") -> Column:
    """end - start in whole seconds (floored); NULL while a run is open."""
    return F.timestamp_diff("SECOND", F.col(start), F.col(end)).cast("long")


def run_metrics(runs: DataFrame, by: str = "table_config_id", approx_p95: bool = False) -> DataFrame:
    """Runs, succeeded, success rate, rows read/written, mean and p95 elapsed per
    (``by``, status) with subtotals per ``by`` and a grand total (ROLLUP; ``gid`` is the
    grouping id). Active runs only. Every aggregate combines map-side; the exact p95
    keeps a value->count map, so its state grows with distinct elapsed values (whole
    seconds), not rows; ``approx_p95`` switches to a fixed-size sketch (percentile_approx)."""
    r = active(runs)
    if "elapsed_seconds" not in r.columns:
        r = r.withColumn("elapsed_seconds", elapsed_seconds())
    g = r.rollup(by, "status").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).cast("long").alias("runs"),
        F.count_if(F.col("status") == "succeeded").cast("long").alias("succeeded"),
        F.sum("rows_read").cast("long").alias("rows_read"),
        F.sum("rows_written").cast("long").alias("rows_written"),
        F.avg("elapsed_seconds").alias("avg_elapsed"),
        (F.percentile_approx(F.col("elapsed_seconds"), 0.95, 10000).cast("double") if approx_p95
         else F.percentile(F.col("elapsed_seconds"), F.lit(0.95))).alias("p95_elapsed"),
    )
    return g.withColumn("success_rate", F.col("succeeded") / F.col("runs"))


SKETCH_K = 4000


def metric_sketches(runs: DataFrame, by: str = "table_config_id", k: int = SKETCH_K) -> DataFrame:
    """R19 as stored state: one row per (``by``, day of start) with counts, sums and a KLL
    sketch of the elapsed seconds. Days are appended as they end; ``merged_metrics`` answers
    any span of days from these rows without the runs. Active runs only; an open run counts
    but has no elapsed time, and a day without any has a NULL sketch."""
    r = active(runs)
    if "elapsed_seconds" not in r.columns:
        r = r.withColumn("elapsed_seconds", elapsed_seconds())
    return r.groupBy(by, F.to_date("start_time").alias("day")).agg(
        F.count(F.lit(1)).cast("long").alias("runs"),
        F.count_if(F.col("status") == "succeeded").cast("long").alias("succeeded"),
        F.count("elapsed_seconds").cast("long").alias("timed"),
        F.sum("elapsed_seconds").cast("long").alias("elapsed"),
        F.when(F.count("elapsed_seconds") > 0, F.kll_sketch_agg_bigint(F.col("elapsed_seconds"), k)).alias("sketch"))


def sketch_error(k: int = SKETCH_K) -> float:
    """Rank error of one quantile of a merged sketch (99 % confidence; about 2.3 / k**0.9 for
    the KLL family): a p95 lies between the exact quantiles at 0.95 -+ this. With at most
    ``k`` timed runs the sketch keeps them all and the quantile is exact."""
    return 2.296 / k**0.9021


def merged_metrics(sketches: DataFrame, by: str | None = "table_config_id", p: float = 0.95, k: int = SKETCH_K) -> DataFrame:
    """Runs, success rate, mean and quantile ``p`` of the elapsed seconds per ``by`` (None: of
    everything) over the given sketch rows. Sketches merge map-side; a group's state is one
    sketch, whatever the number of runs."""
    g = sketches.groupBy(*([by] if by else [])).agg(
        F.sum("runs").alias("runs"), F.sum("succeeded").alias("_ok"), F.sum("timed").alias("timed"), F.sum("elapsed").alias("_sum"),
        F.kll_merge_agg_bigint(F.col("sketch"), k).alias("_sketch"))
    quantile = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("_sketch", F.lit(float(p))))
    return g.select(*([by] if by else []), "runs", "timed", (F.col("_ok") / F.col("runs")).alias("success_rate"),
                    F.when(F.col("timed") > 0, F.col("_sum") / F.col("timed")).alias("avg_elapsed"), quantile.alias("p_elapsed"))


def run_reconcile(runs: DataFrame, now, max_open_hours: int = 24) -> DataFrame:
    """Per run: elapsed = end - start; rows_read != rows_written; watermark_start not
    equal to the previous run's watermark_end (same config, by start_time); a run still
    open after ``max_open_hours`` at ``now``. The previous run comes from the skew-safe
    ``lag_within`` (sorted slices and one carried row per slice), not a window over each config
    nor a join of the runs to themselves."""
    r = active(runs)
    prev = lag_within(r, [F.col("start_time"), F.col("table_run_id")], ["table_config_id"], ["watermark_end", "table_run_id"])
    limit = ts_literal(now) - F.expr(f"INTERVAL {int(max_open_hours)} HOURS")
    return prev.select(
        "table_run_id", "table_config_id", "start_time",
        elapsed_seconds().alias("elapsed_seconds"),
        F.col("prev_table_run_id").alias("prev_run_id"),
        (F.col("rows_read") != F.col("rows_written")).alias("rows_mismatch"),
        (F.col("prev_table_run_id").isNotNull() & ~F.col("watermark_start").eqNullSafe(F.col("prev_watermark_end"))).alias("watermark_gap"),
        ((F.col("status") == "running") & (F.col("start_time") < limit)).alias("running_too_long"),
    )


# ---- fixed values: how old the last success may be per ingestion_frequency ----
FRESHNESS_LIMIT = {"daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAYS", "monthly": "INTERVAL 1 MONTH"}


def freshness(configs: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Active configs with their last successful run end and ``is_stale`` at ``now``:
    older than a day / week / month for daily / weekly / monthly, or never succeeded;
    adhoc configs are never stale. Last success is a per-config max (map-side combined)."""
    ok = active(runs).filter(F.col("status") == "succeeded").groupBy(F.col("table_config_id").alias("_cfg")).agg(
        F.max("end_time").alias("last_success")
    )
    c = active(configs).join(ok, F.col("table_config_id") == F.col("_cfg"), "left").drop("_cfg")
    t = ts_literal(now)
    stale = F.lit(False)
    for freq, interval in FRESHNESS_LIMIT.items():
        stale = F.when(F.col("ingestion_frequency") == freq,
                       F.col("last_success").isNull() | (F.col("last_success") < t - F.expr(interval))).otherwise(stale)
    return c.select("table_config_id", "ingestion_frequency", "last_success", stale.alias("is_stale"))


def tag_index(configs: DataFrame) -> DataFrame:
    """Active configs per tag (tags JSON text; NULL or empty -> no tags)."""
    t = active(configs).select("table_config_id", F.explode(F.array_distinct(decode_json_list("tags"))).alias("tag"))
    return t.groupBy("tag").agg(F.count(F.lit(1)).cast("long").alias("n_configs"))


def with_tag(configs: DataFrame, tag: str) -> DataFrame:
    """R22 filter: configs carrying ``tag``."""
    return configs.filter(F.array_contains(decode_json_list("tags"), F.lit(tag)))

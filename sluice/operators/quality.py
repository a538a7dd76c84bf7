"""Quality and shaping jobs from the BTS configuration (R15-R18). Rules are SQL text
stored in the config rows; Spark parses them into ordinary column expressions, so every
rule of a dataset is evaluated in one pass inside generated code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.schemas import FAIL_MODES
from sluice.session import pin

FAILED = "failed_rules"


@dataclass(frozen=True)
class Rule:
    rule_name: str
    expression: str


def _rules(rules) -> list[Rule]:
    return [r if isinstance(r, Rule) else Rule(r["rule_name"], r["expression"]) for r in rules]


def _passes(rule: Rule) -> Column:
    # a NULL result counts as a failure
    return F.coalesce(F.expr(rule.expression).cast("boolean"), F.lit(False))


def _lenient(df: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(df)`` resolved without ANSI mode: a cast or operation that cannot be done gives
    NULL, so the row fails the rule instead of ending the job. It is resolved in a session of
    its own with this one's settings, so neither this session nor another thread that uses it
    ever sees the setting; the resolved plan keeps that meaning and comes back to this one."""
    spark = df.sparkSession
    apart = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            apart.conf.set(key, value)
    apart.conf.set("spark.sql.ansi.enabled", "false")
    of_rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows  # noqa: SLF001
    there = build(DataFrame(of_rows(apart._jsparkSession, df._jdf.queryExecution().analyzed()), apart))  # noqa: SLF001
    return DataFrame(of_rows(spark._jsparkSession, there._jdf.queryExecution().analyzed()), spark)  # noqa: SLF001


def evaluate_rules(df: DataFrame, rules) -> DataFrame:
    """R15 per row: ``failed_rules`` = names of the rules that are false or NULL, in rule order.
    A rule that cannot be evaluated on a row (a failing cast) is NULL there, so it fails."""
    rs = _rules(rules)
    checks = [F.when(_passes(r), F.lit(None).cast("string")).otherwise(F.lit(r.rule_name)) for r in rs]
    failed = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return _lenient(df, lambda d: d.withColumn(FAILED, failed))


def rule_stats(df: DataFrame, rules) -> DataFrame:
    """R15 per rule: failed count and fail rate, all rules in one aggregation."""
    rs = _rules(rules)
    aggs = [F.count(F.lit(1)).cast("long").alias("_total")]
    aggs += [F.count_if(~_passes(r)).cast("long").alias(f"_r{i}") for i, r in enumerate(rs)]
    one = _lenient(df, lambda d: d.agg(*aggs))
    rows = F.explode(F.array(*[
        F.struct(F.lit(r.rule_name).alias("rule_name"), F.col(f"_r{i}").alias("failed")) for i, r in enumerate(rs)
    ])).alias("_x")
    out = one.select("_total", rows).select("_x.rule_name", "_x.failed", "_total")
    return out.select(
        "rule_name", "failed",
        F.when(F.col("_total") > 0, F.col("failed") / F.col("_total")).alias("fail_rate"),
    )


class DataQualityHalt(Exception):
    """Raised by fail mode ``halt`` before anything is written."""


def apply_fail_mode(df: DataFrame, rules, mode: str) -> tuple[DataFrame, DataFrame]:
    """R16 with R15: returns (rows to write, quarantine rows).

    halt: one counting pass; any failure raises ``DataQualityHalt``, nothing is written.
    skip: bad rows are dropped (the second frame is empty).
    quarantine: bad rows with their failed rule names go to the second frame.
    """
    if mode not in FAIL_MODES:
        raise ValueError(f"unknown fail_mode {mode!r}")
    checked = evaluate_rules(df, rules)
    good = checked.filter(F.size(FAILED) == 0).drop(FAILED)
    bad = checked.filter(F.size(FAILED) > 0)
    if mode == "halt":
        # one evaluation serves the gate and the write
        checked = pin(checked, "dq-checked")
        good, bad = checked.filter(F.size(FAILED) == 0).drop(FAILED), checked.filter(F.size(FAILED) > 0)
        n_bad = checked.agg(F.count_if(F.size(FAILED) > 0)).first()[0]
        if n_bad:
            raise DataQualityHalt(f"{n_bad} rows failed quality rules")
        return good, bad.limit(0)
    if mode == "skip":
        return good, bad.limit(0)
    return good, bad


def run_outcome(df: DataFrame, rules, mode: str) -> DataFrame:
    """R16 -> D36: what the run records for ``mode`` after the rules, in one aggregation:
    rows_read, rows_written (halt writes nothing when any row fails; skip and quarantine
    write the good rows), status, error_type 'dq' and a message naming the failed count."""
    checked = evaluate_rules(df, rules)
    agg = checked.agg(F.count(F.lit(1)).cast("long").alias("rows_read"),
                      F.count_if(F.size(FAILED) > 0).cast("long").alias("_bad"))
    halted = F.lit(mode == "halt") & (F.col("_bad") > 0)
    return agg.select(
        "rows_read",
        F.when(halted, F.lit(0).cast("long")).otherwise(F.col("rows_read") - F.col("_bad")).alias("rows_written"),
        F.when(halted, F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
        F.when(F.col("_bad") > 0, F.lit("dq")).alias("error_type"),
        F.when(F.col("_bad") > 0, F.concat(F.col("_bad").cast("string"), F.lit(f" rows failed quality rules ({mode})"))).alias("error_message"),
    )


# ---- R17 standardisation ----

def _std(col: Column, rule_type: str, value) -> Column:
    t = rule_type.lower()
    if t == "trim":
        return F.trim(col)
    if t == "upper":
        return F.upper(col)
    if t == "lower":
        return F.lower(col)
    if t == "default":
        return F.coalesce(col, F.lit(value))
    if t == "replace":
        old, new = str(value).split("=>", 1)
        return F.replace(col, F.lit(old), F.lit(new))
    if t == "cast":
        return col.try_cast(str(value))
    raise ValueError(f"unknown rule_type {rule_type!r}")


def standardise(df: DataFrame, std_rules) -> DataFrame:
    """Ordered {field, rule_type, rule_value} rules folded into one expression per
    field and applied in a single ``select``. rule_type: trim, upper, lower, default,
    replace ('old=>new', literal), cast (target type, failures NULL)."""
    exprs = {c: F.col(c) for c in df.columns}
    for r in std_rules:
        f = r["field"]
        exprs[f] = _std(exprs[f], r["rule_type"], r.get("rule_value"))
    return df.select(*[e.alias(c) for c, e in exprs.items()])


# ---- R18 silver layout ----

REJECTS = "layout_rejects"


def apply_layout(df: DataFrame, layout) -> DataFrame:
    """Project and cast to the layout [{name, type, nullable}]. A value that fails
    its cast gives 'cast:<name>', a NULL where the layout forbids it 'null:<name>'; the
    reasons are listed in ``layout_rejects`` (empty = accepted, R16 decides the rest)."""
    cols, reasons = [], []
    for f in layout:
        name, typ, nullable = f["name"], f["type"], f.get("nullable", True)
        src = F.col(name)
        cast = src.try_cast(typ)
        cols.append(cast.alias(name))
        reasons.append(F.when(src.isNotNull() & cast.isNull(), F.lit(f"cast:{name}")))
        if not nullable:
            reasons.append(F.when(src.isNull(), F.lit(f"null:{name}")))
    return df.select(*cols, F.array_compact(F.array(*reasons)).alias(REJECTS))

"""Driver contract: entry runs, every registered query has oracle SQL, names are clean."""

from __future__ import annotations

import re

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["table_config_id", "connection_source_id"]


def test_every_query_has_oracle():
    sql = entry.oracle_sql()
    assert len(entry.QUERIES) >= 58
    missing = set(entry.QUERIES) - set(sql)
    assert missing == set(), missing
    assert not [k for k in entry.QUERIES if re.match(r"op\d+_", k) or k == "pipeline"]
    assert set(sql) <= set(entry.queries())


def test_queries_run_on_smallest_data(spark):
    qs = entry.queries()
    for name in ["search_page", "upsert_watermark", "pii_scan", "run_metrics", "schema_drift"]:
        df = qs[name](spark, "/root/testdata/sf0.001")
        df.write.format("noop").mode("overwrite").save()


def test_no_python_in_any_plan(spark):
    import re

    python_nodes = re.compile(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|PythonUDF")
    found = []
    for name, fn in entry.QUERIES.items():
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        if python_nodes.search(plan):
            found.append(name)
    assert found == []

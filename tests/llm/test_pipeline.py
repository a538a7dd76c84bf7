from __future__ import annotations

import corpus_pipeline as CP
from sluice.llm import decontaminate as DC
from sluice.llm import exactdedup as ED
from sluice.llm import neardedup as ND
from sluice.llm import toxicity as TX
from sluice.session import pin

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, at = docs.columns, {}
    for name, stage in CP.STAGES:
        before = docs
        docs = pin(stage(spark, docs, SF), name)
        at[name] = (before, docs)
        assert (docs.columns == columns) == (name != CP.STAGES[-1][0])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = at["toxicity"]
    model = TX.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(TX.score(before, model).where("predicted = 0"))
    before, after = at["exact_dedup"]
    assert ids(after) == ids(ED.exact_groups(before).where("kept"))
    before, after = at["near_dedup"]
    assert ids(after) == ids(ND.near_groups(before).where("kept"))
    before, after = at["decontamination"]
    assert ids(after) == ids(DC.contamination(before, bench).where(~DC.is_contaminated()))
    before, after = at["mixing"]
    assert ids(after) == ids(before)
    assert ids(after) and ids(CP.run(spark, SF)) == ids(after)


def test_every_query_is_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and [n for n, _ in CP.STAGES][0] == "toxicity"

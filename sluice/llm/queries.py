"""Registered queries of the training-data operators, over whole tables with production
parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate as DC
from sluice.llm import exactdedup as ED
from sluice.llm import hardnegatives as HN
from sluice.llm import licenses as LI
from sluice.llm import mixing as MX
from sluice.llm import neardedup as ND
from sluice.llm import packing as PK
from sluice.llm import quality as QL
from sluice.llm import suffixdedup as SD
from sluice.llm import tokencount as TC
from sluice.llm import toxicity as TX
from sluice.llm import urlfilter as UF
from sluice.llm import whitening as WH


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    out = DC.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        DC.is_contaminated().alias("contaminated"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return LI.scan(docs).select("doc_id", *[F.col(f"license.{c}").alias(c) for c in fields])


def op3_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = ND.near_groups(table(spark, sf, "documents"), shingle=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return TX.score(docs, TX.train(docs, table(spark, sf, "labels")))


def _vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = TC.token_counts(table(spark, sf, "documents"), _vocabulary())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = SD.drop_repeats(table(spark, sf, "documents"))
    # what is left as text: a cut inside a character leaves U+FFFD there
    kept = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept.alias("kept_text"))


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return UF.judge(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = ED.exact_groups(table(spark, sf, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return MX.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return QL.score(docs, QL.train(docs, table(spark, sf, "labels")))


def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    out = PK.pack(table(spark, sf, "documents"), _vocabulary(), end_id=0, width=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    out = WH.whiten(table(spark, sf, "embeddings"), components=4)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = HN.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _sql_array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NOTICES = ", ".join(f"({n}, '{t.label}', {_sql_array(LI.words_of(t.notice))}, {len(t.keys)})" for n, t in enumerate(LI.TEMPLATES))
_PHRASES = ", ".join(f"({n}, {p.template}, {p.at}, {_sql_array(p.words)}, {str(p.base).lower()})" for n, p in enumerate(LI.phrases(LI.TEMPLATES)))
_PATTERNS = " OR ".join(f"regexp_matches(subject, '{r.regex}')" for r in UF.PATTERNS)
_SITES = ", ".join(f"('{r.rule}', '{r.rule.split('/', 1)[0]}', '/{r.rule.split('/', 1)[1]}', {str(r.allow).lower()})" for r in UF.SITE_RULES)

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.size, bw.item FROM dw JOIN bw USING (size, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op2_license_scan": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t(template, label, notice, needed) AS (VALUES {_NOTICES}),
p(phrase, template, tpos, k, base) AS (VALUES {_PHRASES}),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
hit AS (
  SELECT doc_id, w, i - 1 AS start, p.* FROM pos JOIN p ON w[i] = k[1] AND list_slice(w, i, i + len(k) - 1) = k),
place AS (
  SELECT doc_id, any_value(w) AS w, template, start - tpos AS o FROM hit JOIN t USING (template)
  GROUP BY doc_id, template, start - tpos HAVING count(*) >= any_value(needed)),
cov AS (
  SELECT doc_id, label, len(list_filter(generate_series(0, len(notice) - 1), lambda j: o + j >= 0 AND w[o + j + 1] = notice[j + 1])) / len(notice) AS c
  FROM place JOIN t USING (template)),
lab AS (
  SELECT doc_id, label, true AS base FROM hit JOIN t USING (template) WHERE base UNION SELECT doc_id, label, false FROM cov),
labs AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels FROM lab GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM hit WHERE base GROUP BY doc_id),
s AS (SELECT doc_id, max(c) AS score FROM cov GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN labs USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op7_url_filter": f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_replace(rest, '^[^/?#]*', '') AS after FROM u),
x AS (SELECT page_id, host, regexp_extract(after, '^[^?#]*') AS path, host || after AS subject FROM h),
r(rule, rhost, rpath, allow) AS (VALUES {_SITES}),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(allow, length(rule)) AS allow
  FROM x JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN CASE WHEN allow THEN 'allow' ELSE 'block' END WHEN {_PATTERNS} THEN 'block' ELSE 'allow' END AS verdict
FROM x LEFT JOIN best USING (page_id)""",
    "op13_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
    CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""",
}

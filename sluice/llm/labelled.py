"""Bounded samples of labelled documents for fitting the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import pin

SPAN = 1 << 30
_SALT = 11


def held_out(id_col: str) -> Column:
    """Rows whose labels are never used: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def _draw(id_col: str, total: int, bound: int) -> Column:
    """A seeded draw of about ``bound`` of ``total`` rows, by the id's hash."""
    share = min(1.0, bound / total) if total else 1.0
    return F.pmod(F.xxhash64(F.lit(_SALT), F.col(id_col).cast("string")), F.lit(SPAN)) < int(share * SPAN)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str, text_col: str, only: int | None = None) -> DataFrame:
    """Rows (text, y), pinned: about ``bound`` labelled documents outside the held-out part.

    Labels that are null or not 0/1, null ids and ids with both labels are left out. The
    drawn label rows, whose number the bound fixes, are broadcast, so document texts are
    filtered in their scan and never shuffled."""
    lab = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y"))
    lab = lab.where(F.col("l_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("l_id"))
    lab = lab.groupBy("l_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    if only is not None:
        lab = lab.where(F.col("y") == only)
    lab = pin(lab, "labels")
    lab = lab.where(_draw("l_id", lab.count(), bound))
    d = docs.select(F.col(id_col).alias("l_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return pin(d.join(F.broadcast(lab), "l_id").select("text", "y"), "labelled")


def drawn_texts(docs: DataFrame, bound: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (text), pinned: about ``bound`` documents outside the held-out part, drawn from
    all documents alike, whether they have a label or not."""
    d = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return pin(d.where(_draw("id", d.count(), bound)).select("text"), "drawn")

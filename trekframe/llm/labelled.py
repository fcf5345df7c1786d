"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document belongs to the third of all ids that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int = 256 << 20) -> DataFrame:
    """``(doc_id, text, lang, y)`` of at most ``max_rows`` labelled documents outside the held-out third, whose texts
    have at most ``max_bytes`` together.

    The rows are those with the smallest hashes of their id, so the choice does not depend on how the tables are laid
    out. At most ``max_rows`` ids are broadcast to the scan of the documents. Labels other than 0 and 1 are left out;
    a document labelled more than once counts with its largest label, one that stands in several rows with its least
    text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    met = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("row"))
    met = met.select("doc_id", "row.text", "row.lang", "y")
    sizes = met.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))  # at most max_rows numbers
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = sizes.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id")
    return met.join(F.broadcast(fits), "doc_id")

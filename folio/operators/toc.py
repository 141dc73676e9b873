"""Tables of contents from headings (doc, pos, depth, slug, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.config import TOC_DEPTH
from folio.functions.text import without_trailing_hash

#: Fixed value: the least depth of a document without headings.
NO_DEPTH = 10


def contents(headings: DataFrame, levels: int = TOC_DEPTH) -> DataFrame:
    """(doc, pos, indent, number, slug, text) of the headings less than `levels` below the document's topmost.

    number counts the topmost headings from 1 and is null for others. A window is one document.
    """
    doc = Window.partitionBy("doc")
    until = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    indent = F.col("depth") - F.min("depth").over(doc)
    shown = headings.withColumn("indent", indent).withColumn("__n", F.count(F.when(F.col("indent") == 0, 1)).over(until))
    number = F.when(F.col("indent") == 0, F.col("__n"))
    return shown.where(F.col("indent") < levels).select("doc", "pos", "indent", number.alias("number"), "slug", without_trailing_hash(F.col("text")).alias("text"))


def least_depths(docs: DataFrame, headings: DataFrame, doc: str = "slug") -> DataFrame:
    """(doc, min_depth) of every document; NO_DEPTH without headings."""
    least = headings.groupBy("doc").agg(F.min("depth").alias("d"))
    return docs.select(F.col(doc).alias("doc")).join(least, "doc", "left").select("doc", F.coalesce("d", F.lit(NO_DEPTH)).alias("min_depth"))


def visible_run(headings: DataFrame, active: str = "active") -> DataFrame:
    """(doc, first_pos, last_pos): each document's last unbroken run of active headings; documents without one are left out."""
    doc = Window.partitionBy("doc")
    last = F.max(F.when(F.col(active), F.col("pos"))).over(doc)
    marked = headings.withColumn("__last", last).where(F.col("__last").isNotNull() & (F.col("pos") <= F.col("__last")))
    broken = F.max(F.when(~F.coalesce(F.col(active), F.lit(False)), F.col("pos"))).over(doc)
    run = marked.withColumn("__broken", broken).where(F.coalesce(F.col("pos") > F.col("__broken"), F.lit(True)))
    return run.groupBy("doc").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))

"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 60-bit hash of its id. A source's words are summed by the hash's
leading 12 bits; the running sum over these at most 4,096 buckets shows which bucket a budget
ends in. Only that bucket is split again (12 bits, then single hashes), so one threshold per
source is found without sorting documents, and a document is taken by comparing its hash with it.

Thresholds nest: a smaller budget of the same source always takes a subset of the documents that
a larger one takes, and reruns take the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import word_count, written

#: Hash bits: 12 for the first histogram, 12 for the refined bucket, 36 below.
HASH_HEX, FIRST_SHIFT, SECOND_SHIFT = 15, 48, 36


def id_hash(doc_id: Column) -> Column:
    """The leading 60 bits of the id's MD5 (null: of the empty string)."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_HEX)
    return F.conv(hexed, 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets from (source, source_size): weights repeat over the sources in code-point order, null last.

    Targets share the sum of all sizes by weight. None exceeds max_epochs times its source; what that
    cuts off goes to the others by weight, again and again, until none is above. The fixed point is
    min(cap, weight * level) with one level for all, found from running sums over the sources ordered
    by cap / weight. The unpartitioned windows see one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all_size") - F.col("caps_before")).cast("double") / (F.col("all_weight") - F.col("weight_before"))
    return (
        totals.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("nth", F.row_number().over(by_cap))
        .withColumn("own_level", level)
        .withColumn("level", F.min(F.when(F.col("own_level") <= F.col("full_at"), F.struct("nth", "own_level"))).over(everything)["own_level"])
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))
    )


def _same_source(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    on = a["source"].eqNullSafe(b["source"])
    for k in keys:
        on &= a[k] == b[k]
    return on


def _boundary(histogram: DataFrame, bucket: str, group: list[str]) -> DataFrame:
    """Of each source's buckets, the first whose running sum reaches the budget; before: the words ahead of it."""
    running = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return (
        histogram.withColumn("upto", F.col("before") + F.sum("words").over(running))
        .where(F.col("upto") >= F.col("budget"))
        .groupBy(*group, "budget")
        .agg(F.min_by(F.struct(F.col(bucket), (F.col("upto") - F.col("words")).alias("ahead")), bucket).alias("at"))
        .select(*group, "budget", F.col(f"at.{bucket}").alias(bucket), F.col("at.ahead").alias("before"))
    )


def thresholds(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h, b1) of every row, and one row per source: source_size, target, epochs, cut.

    The second is a written table: Spark broadcasts it below spark.sql.autoBroadcastJoinThreshold and
    otherwise shuffles, where AQE splits a source that holds much of the rows.
    """
    sized = written(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            word_count(F.col("text")).alias("size"),
            id_hash(F.col("doc_id")).alias("h"),
        ).withColumn("b1", F.shiftright("h", FIRST_SHIFT)),
        "sizes",
    )
    histogram = sized.groupBy("source", "b1").agg(F.sum("size").alias("words"))
    targets = source_targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = written(
        targets.withColumn("epochs", whole).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    first = histogram.join(targets, _same_source(histogram, targets)).select(histogram["source"], "b1", "words", "budget", F.lit(0).alias("before"))
    first = written(_boundary(first, "b1", ["source"]), "first")
    inner = (
        sized.join(first, _same_source(sized, first, "b1"))
        .select(sized["source"], sized["b1"], "h", "size", "budget", "before")
        .withColumn("b2", F.shiftright("h", SECOND_SHIFT).bitwiseAND(F.lit((1 << (FIRST_SHIFT - SECOND_SHIFT)) - 1)))
    )
    inner = written(inner, "boundary")
    keys = ["source", "b1"]
    second = _boundary(inner.groupBy(*keys, "b2", "budget", "before").agg(F.sum("size").alias("words")), "b2", keys)
    second = second.select(F.col("source").alias("s"), F.col("b2").alias("c2"), "budget", F.col("before").alias("ahead"))
    single = (
        inner.drop("budget", "before")
        .join(second, F.col("source").eqNullSafe(F.col("s")) & (F.col("b2") == F.col("c2")))
        .groupBy("source", "b1", "b2", "budget", "ahead", "h")
        .agg(F.sum("size").alias("words"))
    )
    running = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    nearer = 2 * F.col("upto") - F.col("words") < 2 * F.col("budget")
    below = F.shiftleft("b1", FIRST_SHIFT) + F.shiftleft("b2", SECOND_SHIFT) - 1
    cuts = (
        single.withColumn("upto", F.col("ahead") + F.sum("words").over(running))
        .groupBy("source", "b1", "b2")
        .agg(F.max(F.when(nearer, F.col("h"))).alias("last"))
        .select(F.col("source").alias("s"), F.coalesce("last", below).alias("cut"))
    )
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return sized, written(plan.select("source", "source_size", "target", "epochs", F.coalesce("cut", F.lit(-1)).alias("cut")), "plan")


def _copies(hashed: Column) -> Column:
    return (F.col("epochs") + (hashed <= F.col("cut")).cast("long")).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies (targets: see source_targets).

    copies = whole epochs of the source, and 1 more if the document's hash is at or below the source's
    threshold; taken = size * copies. The threshold is the one whose sum comes nearest to the budget, so
    a source misses its target by at most half of the one document at the boundary (of all documents
    with that hash).

    Null or empty texts have size 0 and take 0 words; beyond the last document that the budget reaches they
    get no more copies than others, so that copies are never above max_epochs. A null source is a source of its own. Rows that
    repeat an id share a hash: they are taken together. An empty table gives an empty result. Other
    columns of docs play no part.
    """
    sized, plan = thresholds(docs, weights, max_epochs)
    return (
        sized.join(plan, _same_source(sized, plan))
        .withColumn("copies", _copies(F.col("h")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The rows of docs, each as often as mix() takes it (0 to max_epochs times), in the columns of docs."""
    _, plan = thresholds(docs.select("doc_id", "text", "source"), weights, max_epochs)
    plan = plan.select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut"))
    times = (F.col("__epochs") + (id_hash(docs["doc_id"]) <= F.col("__cut")).cast("long")).cast("int")
    row = F.struct(*[docs[c] for c in docs.columns])
    found = docs.join(plan, docs["source"].eqNullSafe(F.col("__source")))
    return found.select(F.explode(F.array_repeat(row, times)).alias("row")).select("row.*")


ORACLE = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as weight from s),
c as (select *, cast(3 * source_size as double) / weight as full_at, sum(source_size) over () as all_size, sum(weight) over () as all_weight from w),
p as (select *, row_number() over o as nth,
             coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as caps_before,
             coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as weight_before
      from c window o as (order by full_at, source asc nulls last)),
l as (select *, cast(all_size - caps_before as double) / cast(all_weight - weight_before as double) as own_level from p),
v as (select own_level as lev from l where own_level <= full_at order by nth limit 1),
t as (select source, source_size, least(cast(3 * source_size as double), weight * coalesce((select lev from v), 0.0)) as target from p),
b as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
u as (select source, h, sum(size) as words from d group by source, h),
r as (select *, sum(words) over (partition by source order by h rows between unbounded preceding and current row) as upto from u)
select d.doc_id, cast(d.size as bigint) as size, b.source_size, b.target,
       cast(d.size * (b.epochs + (case when 2 * r.upto - r.words < 2 * (b.target - b.epochs * b.source_size) then 1 else 0 end)) as bigint) as taken,
       cast(b.epochs + (case when 2 * r.upto - r.words < 2 * (b.target - b.epochs * b.source_size) then 1 else 0 end) as integer) as copies
from d join b on d.source is not distinct from b.source join r on d.source is not distinct from r.source and d.h = r.h
"""

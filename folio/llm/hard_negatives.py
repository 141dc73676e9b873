"""Hard negatives by distributed radix selection.

An anchor's positives are the best other rows of its label. Each positive opens a window of scores, and
the anchor's best rows of other labels within it are its negatives. No list of scores is ever sorted or
written: blocks of vectors are scored against blocks of anchors, and each pass gives a histogram of the
next digit of the score (counted from the window's upper end) for every window. Summed over the blocks
they show the digit that the k-th score has; windows are refined digit by digit until the rows of the last
bucket are few or share one score. Only rows up to that bucket are gathered then and ranked.

Scores are computed again in each pass, which costs less than to write them: they are as many as
anchors times rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .common import passing_tables, written

#: Bits of a digit, and rows of a bucket up to which it is gathered instead of refined.
DIGIT, GATHER = 12, 64

_WINDOW = ["anchor_id", "positive_id"]


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["x"].to_list()).reshape(len(rows), -1)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to smaller ids; ids ascend."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
        return at[np.argsort(~score[at], kind="stable")][:k]  # ~s orders longs downwards and cannot overflow
    return np.argsort(~score, kind="stable")


def _listed(columns: str, found: list[tuple[tuple[int, ...], tuple[np.ndarray, ...]]]) -> pd.DataFrame:
    """A table of longs from parts: values that hold for a part's rows, then arrays with one value for each of them."""
    names = columns.split()
    if not found:
        return pd.DataFrame(columns=names).astype("int64")
    shared, own = zip(*found, strict=True)
    shared = np.repeat(np.array(shared, "int64"), [len(arrays[0]) for arrays in own], axis=0)
    return pd.DataFrame(dict(zip(names, [*shared.T, *map(np.concatenate, zip(*own, strict=True))], strict=True)))


def positives(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the k best other rows with the anchor's label."""
    ddl = "anchor_id long, positive_id long, positive_score long"

    def work(block: pd.Series | None, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked):
            ids, labels, x = vectors.unpacked(block)
            asked, last = asked.sort_values("label"), None
            for a, label, score in zip(asked["anchor_id"], asked["label"], vectors.each_scores(_matrix(asked), x), strict=True):
                if label != last:
                    same, last = np.flatnonzero(labels == label), label
                own = same[ids[same] != a]
                best = own[_best(ids[own], score[own], k)]
                out.append(((a,), (ids[best], score[best])))
        return _listed("anchor_id positive_id positive_score", out)

    found = vectors.meet(blocks, anchors, work, ddl)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _windows(found: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """Adds the window's ends (lo, hi), in tenths of the positive's score rounded inwards, and the selection's start; empty windows go.

    Offsets are counted down from hi. What is selected lies below `base`, or in the part from base on
    that the next digit (above `shift` bits) divides; `need` rows of it are wanted.
    """
    found, rest = found.where("positive_score >= 0"), F.pmod("positive_score", F.lit(10))
    tens = F.expr("(positive_score - pmod(positive_score, 10L)) div 10L")
    ends = found.withColumn("lo", tens * low + F.expr(f"({low} * pmod(positive_score, 10L) + 9) div 10L")).withColumn("hi", tens * high + F.floor(rest * high / 10).cast("long"))
    ends = ends.where("lo <= hi")
    bits = F.length(F.bin(F.col("hi") - F.col("lo")))
    return ends.withColumns({"base": F.lit(0).cast("long"), "shift": F.greatest(F.lit(0), bits - DIGIT).cast("int"), "need": F.lit(k).cast("long"), "open": F.lit(True)})


def _met(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """What meets the blocks: of each anchor that has windows a row with its vector, and its windows without one."""
    longs = ("positive_id", "positive_score", "lo", "hi", "base", "need", "upto")
    own = anchors.join(windows, "anchor_id", "left_semi").withColumns({c: F.lit(0).cast("long") for c in longs} | {"shift": F.lit(0), "window": F.lit(False)})
    return own.unionByName(windows.withColumns({"x": F.array().cast("array<double>"), "window": F.lit(True)}).select(own.columns))


def _digits(blocks: DataFrame, anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, digit, n): how many rows of other labels have each digit; from a block no digit beyond that in which it alone has `need` rows."""
    ddl = "anchor_id long, positive_id long, digit long, n long"

    def work(block: pd.Series | None, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w, _, _, offsets in _offsets(block, asked):
            inside = offsets[(offsets >= w.base) & (offsets - w.base <= min((1 << (w.shift + DIGIT)) - 1, vectors.MOST))]
            digit = (inside - w.base) >> w.shift
            if len(digit) > w.need:
                digit = digit[digit <= np.partition(digit, w.need - 1)[w.need - 1]]
            out.append(((w.anchor_id, w.positive_id), np.unique(digit, return_counts=True)))
        return _listed("anchor_id positive_id digit n", out)

    return vectors.meet(blocks, _met(anchors, windows), work, ddl).groupBy(*_WINDOW, "digit").agg(F.sum("n").alias("n"))


def _offsets(block: pd.Series | None, asked: pd.DataFrame) -> Iterator[tuple]:
    """For each window the ids and scores of the block's rows of other labels within it, and their distances from its upper end."""
    if not len(asked):
        return
    ids, labels, x = vectors.unpacked(block)
    asked, last = asked.sort_values(["label", "anchor_id"]), None
    windows = asked[asked["window"]].drop(columns="x").itertuples(index=False)
    found = vectors.each_scores(_matrix(asked[~asked["window"]]), x)
    for ((label, _), own), score in zip(groupby(windows, key=lambda w: (w.label, w.anchor_id)), found, strict=True):
        if label != last:
            others, last = np.flatnonzero(labels != label), label
        score = score[others]
        for w in own:
            at = np.flatnonzero((score >= w.lo) & (score <= w.hi))
            yield w, ids[others[at]], score[at], w.hi - score[at]


def _narrowed(windows: DataFrame, digits: DataFrame) -> DataFrame:
    """The windows after a pass: `base` is where the k-th row's bucket begins, `upto` where it ends, closed if that is fine enough.

    Where a window holds fewer rows than wanted it is closed with its own lower end.
    """
    running = Window.partitionBy(*_WINDOW).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    reached = digits.withColumn("upto_n", F.sum("n").over(running)).join(windows.select(*_WINDOW, "need"), _WINDOW).where("upto_n >= need")
    at = reached.groupBy(*_WINDOW).agg(F.min_by(F.struct("digit", "n", (F.col("upto_n") - F.col("n")).alias("ahead")), "digit").alias("at"))
    joined = windows.join(at, _WINDOW, "left")
    start = F.expr("base + shiftleft(at.digit, shift)")
    fine = F.col("at").isNull() | (F.col("shift") == 0) | (F.col("at.n") <= GATHER)
    return joined.select(
        *[c for c in windows.columns if c not in ("base", "shift", "need", "open", "upto")], F.coalesce(start, "base").alias("base"),
        F.when(F.col("at").isNull(), F.col("hi") - F.col("lo")).otherwise(start + F.expr("shiftleft(1L, shift) - 1")).alias("upto"),
        F.greatest(F.lit(0), F.col("shift") - DIGIT).alias("shift"), (F.col("need") - F.coalesce("at.ahead", F.lit(0))).alias("need"), (~fine).alias("open"),
    )


def _gathered(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """Of each block and window the rows up to the k-th row's bucket, the k best if they are more."""
    ddl = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def work(block: pd.Series | None, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w, ids, score, offsets in _offsets(block, asked):
            own = np.flatnonzero(offsets <= w.upto)
            best = own[_best(ids[own], score[own], k)]
            out.append(((w.anchor_id, w.positive_id, w.positive_score), (ids[best], score[best])))
        return _listed("anchor_id positive_id positive_score negative_id negative_score", out)

    return vectors.meet(blocks, _met(anchors, windows), work, ddl)


def mine(rows: DataFrame, anchor_every: int = 100, n_positives: int = 5, n_negatives: int = 10, tenths: tuple[int, int] = (3, 9)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor's hard negatives.

    rows: vec_id, embedding, label. Rows with a null id, label or vector, or null or non-finite components, take
    no part; of rows that repeat an id the one of least (label, vector) counts. Anchors: ids divisible by
    anchor_every. Scores are inner products of floor(256 * component), higher ones first, ties to smaller ids;
    vectors of different lengths are never compared, and a score beyond 64 bits counts as the nearest long.
    A window reaches from tenths[0] to tenths[1] tenths of the positive's score. Anchors without positives and
    windows without rows give none. An empty table gives an empty result; other columns are left out.
    """
    known = vectors.scaled(rows.where("label is not null"), "label").select("vec_id", F.struct(F.col("label").cast("long").alias("label"), "x").alias("own"))
    known = known.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.label", "own.x")
    with passing_tables(rows.sparkSession) as keep:
        blocks = vectors.packed(known)
        anchors = known.where(F.pmod("vec_id", F.lit(anchor_every)) == 0).withColumnRenamed("vec_id", "anchor_id")
        anchors = written(vectors.asked(anchors, "anchor_id"), "anchors")
        windows = _windows(positives(blocks, anchors, n_positives).join(anchors.drop("x"), "anchor_id"), *tenths, n_negatives)
        windows = open_ = written(windows.withColumn("upto", F.lit(0).cast("long")), "windows")
        closed: list[DataFrame] = []
        while not open_.isEmpty():
            windows = written(_narrowed(open_, _digits(blocks, anchors, open_)), "windows")
            closed.append(windows.where("not open"))
            open_ = windows.where("open")
        ready = closed[0] if closed else windows.where("not open")
        for more in closed[1:]:
            ready = ready.unionByName(more)
        found = keep(_gathered(blocks, anchors, ready, n_negatives), "negatives")
    order = Window.partitionBy(*_WINDOW).orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The query's rows: where vec_id is divisible by 7 the label is (label + 1) % 10."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


ORACLE = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select vec_id, label, x from (select *, row_number() over (partition by vec_id order by label, x) as nth from e) where nth = 1),
s as (select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same, cast(list_sum(list_transform(list_zip(a.x, c.x), lambda z: z[1] * z[2])) as bigint) as score
      from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(a.x) = len(c.x)),
p as (select anchor_id, other_id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, other_id) as nth from s where same) where nth <= 5),
n as (select p.*, s.other_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words and word beginnings that are far more common in toxic texts. The
dense features are densities of its entries, how near they stand to second-person words, and rates
of capitals, punctuation and obfuscated words. Spark ML fits the trees on the labelled rows, and an
isotonic curve from probabilities to labels by cross-fitting: each half of the rows gets the
probabilities of a lexicon and trees learned from the other half. All fit on a bounded sample (SAMPLE),
everything is scored. Where a class is sampled, its rows weigh as much as all its
learnable labels, so that a score stands for the labels' own share of toxic rows at every size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_arrow, written

#: Labelled rows of either class that fitting takes at most, those of least hash.
SAMPLE = {1: 4_000, 0: 8_000}
#: Of crc32(doc_id) mod FOLDS: 0 is never learned from.
FOLDS = 5
#: A lexicon entry is in at least this share of the toxic texts (and in SUPPORT of them) and so many times likelier there.
SUPPORT, SUPPORT_SHARE, LEAST_ODDS = 4, 0.01, 8.0
#: Lengths of word beginnings that may be entries.
BEGINNINGS = (4, 5, 6)
#: Words on either side in which a second-person word counts as near.
NEAR = 5

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Characters that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasii")

_WORD = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUTED = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-Þ]{2,}(?![^\W\d_])")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~¡¿…–—]")
_HIDDEN = re.compile(r"[^\W\d_][*@$!|0-9]{1,3}(?=[^\W\d_])")
_SPACES = " \t\n\v\f\r"
_EDGE = re.compile(f"[{_SPACES}]")

FEATURES = (
    "log_hits", "hit_density", "weight_density", "greatest_weight", "log_distinct_hits", "near_share",
    "second_person_density", "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "hidden_hits", "log_words",
)


class _Weights(dict):
    """word -> the greatest weight of the lexicon entries that it is or begins with; 0 for others. Remembers a bounded number."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        get = self.lexicon.get
        if len(self) > 300_000:
            self.clear()
        self[word] = found = max(get(word, 0.0), *(get(f"{word[:n]}*", 0.0) for n in BEGINNINGS if len(word) >= n), 0.0)
        return found


def dense_features(text: str | None, weights: _Weights) -> list[float]:
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n, size = max(1, len(words)), max(1, len(text))
    hits = [(i, w) for i, w in enumerate(map(weights.__getitem__, words)) if w]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = sum(any(x in SECOND_PERSON for x in words[max(0, i - NEAR) : i + NEAR + 1]) for i, _ in hits)
    hidden, hidden_hits, done = 0, [], 0
    for m in _HIDDEN.finditer(low):
        if m.start() < done:
            continue
        # the whole run without white space around it; what lies before `done` has been looked at
        start = max(done, *(low.rfind(c, done, m.start()) + 1 for c in _SPACES))
        end = _EDGE.search(low, m.end())
        done = end.start() if end else len(low)
        hidden += 1
        hidden_hits += [x for w in _WORD.findall(low[start:done].translate(LEET).replace("*", "")) if (x := weights[w])]
    all_weights = [w for _, w in hits] + hidden_hits
    return [
        math.log1p(len(all_weights)), len(all_weights) / n, sum(all_weights) / n, max(all_weights, default=0.0),
        math.log1p(len({words[i] for i, _ in hits})), near / max(1, len(hits)), len(second) / n,
        len(_CAPITAL.findall(text)) / size, len(_SHOUTED.findall(text)) / n, len(_PUNCTUATION.findall(text)) / size,
        text.count("!") / size, hidden / n, math.log1p(len(hidden_hits)), math.log1p(len(words)),
    ]


FEATURE_COLUMN = "__tox_features"


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """docs with its text's dense features as another column."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(lexicon)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = pa.array([dense_features(t, weights) for t in part.column(at).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, FEATURE_COLUMN])

    return map_arrow(docs, work, T.StructType([*docs.schema.fields, T.StructField(FEATURE_COLUMN, T.ArrayType(T.DoubleType()))]))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS (null: of the empty string)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def learned_lexicon(sample: DataFrame) -> dict[str, float]:
    """entry -> log odds from sample (text, toxic); beginnings end in `*`.

    Each entry is in SUPPORT_SHARE of the toxic texts at least, so that there are 100 times as many as such a
    text has words and beginnings at most, whatever the sample's size.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    words = F.filter(words, lambda w: F.length(w) >= 3)
    begins = [F.transform(F.filter(words, lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in BEGINNINGS]
    entries = F.explode(F.array_distinct(F.concat(words, *begins)))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    counts = sample.select("toxic", entries.alias("entry")).groupBy("entry").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g"))
    odds = ((F.col("b") + 0.5) / (bad + 1)) / ((F.col("g") + 0.5) / (good + 1))
    found = counts.where((F.col("b") >= max(SUPPORT, SUPPORT_SHARE * bad)) & (odds >= LEAST_ODDS))
    return {r["entry"]: r["w"] for r in found.select("entry", F.log(odds).alias("w")).orderBy("entry").collect()}


@dataclass
class Trees:
    """A lexicon and trees learned with it; of labels of one kind only, no trees but their constant."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    constant: float

    def probabilities(self, docs: DataFrame) -> DataFrame:
        """docs with __tox_p; only its text is an input."""
        if self.trees is None:
            return docs.withColumn("__tox_p", F.lit(self.constant))
        vectors = with_features(docs, self.lexicon).withColumn("__tox_vector", array_to_vector(FEATURE_COLUMN))
        return self.trees.transform(vectors).withColumn("__tox_p", vector_to_array("__tox_probability")[1])


@dataclass
class ToxicityModel:
    """score() of any table with a text column. Without labels of both kinds: a constant score."""

    trees: Trees
    curve: IsotonicRegressionModel | None

    def score(self, docs: DataFrame, column: str = "score") -> DataFrame:
        """docs with a score of 0 to 1."""
        raw = self.trees.probabilities(docs)
        if self.curve is None:
            return raw.withColumn(column, F.col("__tox_p")).select(*docs.columns, column)
        bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__tox_score")))
        return self.curve.transform(raw).withColumn(column, bounded).select(*docs.columns, column)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(half, toxic, weight, text) of at most SAMPLE labelled rows with a fold that is not 0, each class's by least hash of the id.

    half: 0 and 1 by turns in each class. weight: of the class's learnable labels, how many one sampled row
    stands for (1 where all are taken).

    A document with several labels is toxic if one says so; one whose rows repeat counts as often. Only
    the ids are sampled and sorted; texts are not shuffled while the sample is below the broadcast limit.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0).withColumn("x", F.xxhash64("doc_id"))
    known = written(known, "known")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = (max(1.0, counts.get(c, 0) / SAMPLE[c]) for c in (1, 0))
    some = [known.where(F.col("toxic") == c).orderBy("x", "doc_id").limit(n).select("doc_id", "toxic", "x") for c, n in SAMPLE.items()]
    turn = F.row_number().over(Window.partitionBy("toxic").orderBy("x", "doc_id"))  # SAMPLE rows at most
    chosen = written(some[0].union(some[1]).withColumn("half", F.pmod(turn, F.lit(2))).drop("x"), "labels")
    weight = F.when(F.col("toxic") == 1, F.lit(bad)).otherwise(F.lit(good)).alias("weight")
    return written(docs.select("doc_id", "text").join(chosen, "doc_id").select("half", "toxic", weight, "text"), "sample")


def fitted(sample: DataFrame) -> Trees:
    """Lexicon and trees from sample (toxic, weight, text)."""
    kinds = {r["toxic"] for r in sample.select("toxic").distinct().collect()}
    if kinds != {0, 1}:
        return Trees({}, None, float(1 in kinds))
    lexicon = learned_lexicon(sample)
    featured = written(with_features(sample, lexicon).drop("text"), "features")
    trees = GBTClassifier(
        featuresCol="__tox_vector", labelCol="toxic", weightCol="weight", predictionCol="__tox_class",
        maxIter=15, maxDepth=3, stepSize=0.3, maxBins=32, seed=7, cacheNodeIds=False,
    )
    trees.setProbabilityCol("__tox_probability").setRawPredictionCol("__tox_margin")
    return Trees(lexicon, trees.fit(featured.withColumn("__tox_vector", array_to_vector(FEATURE_COLUMN)).coalesce(4)), 0.0)


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from labelled_sample(); see ToxicityModel for tables without labels of both kinds. The same steps at every number of labels."""
    sample = labelled_sample(docs, labels)
    whole = fitted(sample)
    if whole.trees is None:
        return ToxicityModel(whole, None)
    by_half = [fitted(sample.where(F.col("half") != h)).probabilities(sample.where(F.col("half") == h)) for h in (0, 1)]
    points = by_half[0].select("__tox_p", "toxic", "weight").union(by_half[1].select("__tox_p", "toxic", "weight"))
    curve = IsotonicRegression(featuresCol="__tox_p", labelCol="toxic", weightCol="weight", predictionCol="__tox_score")
    return ToxicityModel(whole, curve.fit(written(points.withColumn("toxic", F.col("toxic").cast("double")), "points")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    held_out: the id's fold is 0, its label was not learned from. predicted: 1 if score >= 0.5. Null and
    empty texts are scored by the features of an empty text; rows that repeat are scored alike. Empty
    labels: score 0. An empty table gives an empty result. Other columns are left out.
    """
    scored = train(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, in the columns of docs."""
    return train(docs, labels).score(docs, "__tox_score_of_row").where("__tox_score_of_row < 0.5").select(*docs.columns)

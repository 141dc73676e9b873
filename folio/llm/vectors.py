"""What the operators on vectors share: whole-number components, exact scores, packed blocks and how blocks meet queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sums of products below this are exact in float64.
EXACT = 1 << 53
#: Scores are longs; one beyond them is given, ranked and compared as the nearest long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Numbers in a packed block of vectors at most, on average (2 MB in a task), and rows in a block of queries.
BLOCK_NUMBERS, QUERY_BLOCK = 1 << 18, 4096
#: Scores made at once (4 MB).
SCORES = 1 << 19
#: Blocks in a file. Parquet's pages and the batches it is read in count rows, not bytes: the blocks of a file are in memory at once.
FILE_BLOCKS = 4


def scaled(vectors: DataFrame, *others: str) -> DataFrame:
    """(vec_id, *others, x array<double>): floor(256 * component); rows with a null id, or null or non-finite components, are left out.

    Doubles from 2 ** 52 on are whole already and stay as they are. A component whose product with 256 is
    beyond a double (over 7e305) counts as non-finite.
    """
    whole = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    floor = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), *others, whole.alias("x"))
    return kept.where(F.forall("x", finite)).withColumn("x", F.transform("x", floor))


def clamped(score: int) -> int:
    return min(max(score, LEAST), MOST)


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products (a row of `rows` by a row of `queries`) of whole numbers held as float64, exact, as longs."""
    dims = max(1, rows.shape[1])
    limit = (EXACT / dims) ** 0.5
    large_rows, large_queries = (np.flatnonzero(np.abs(m).max(axis=1, initial=0) >= limit) for m in (rows, queries))
    if not len(large_rows) and not len(large_queries):
        return (rows @ queries.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = np.frompyfunc(clamped, 1, 1)
    small_rows, small_queries = (np.where(np.isin(np.arange(len(m)), large)[:, None], 0, m) for m, large in ((rows, large_rows), (queries, large_queries)))
    out = (small_rows @ small_queries.T).astype(np.int64)
    if len(large_rows):
        out[large_rows] = exact(whole(rows[large_rows]).dot(whole(queries).T)).astype(np.int64)
    if len(large_queries):
        out[:, large_queries] = exact(whole(rows).dot(whole(queries[large_queries]).T)).astype(np.int64)
    return out


def each_scores(queries: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """For each query its scores with all rows, made for some queries at once."""
    step = max(1, SCORES // max(1, len(rows)))
    for at in range(0, len(queries), step):
        yield from scores(queries[at : at + step], rows)


def _dealt(rows: DataFrame, id_cols: list[str], block: str, number: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with `dim` and `block`: those of one length are dealt by hash into number(rows, dim) blocks.

    Lengths are few: joined otherwise, all rows of one length would go to one task.
    """
    rows = rows.withColumn("dim", F.size("x"))
    counts = rows.groupBy("dim").agg(F.count("*").alias("__rows"))
    n = F.greatest(F.lit(1), F.ceil(number(F.col("__rows"), F.greatest("dim", F.lit(1))))).cast("int")
    return rows.join(F.broadcast(counts.select("dim", n.alias("__n"))), "dim").withColumn(block, F.pmod(F.xxhash64(*id_cols), F.col("__n")).cast("int")).drop("__n")


def packed(rows: DataFrame, lists: bool = False, number: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(dim, block, ids, labels, x, lists): rows (vec_id, label long, x) of one length in number(rows, dim) blocks, as bytes; a written table.

    lists: for each dimension the places of the block's rows in ascending order of their value, if asked for.
    No two rows are equal, so that the hash deals them evenly.
    """
    dealt = _dealt(rows, ["vec_id", "x"], "block", number or (lambda n, dim: n * dim / BLOCK_NUMBERS))

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vec_id", kind="stable")
        x = np.stack(own["x"].to_list()).reshape(len(own), -1)
        order = np.argsort(x, axis=0, kind="stable").astype("int32") if lists else np.zeros(0, "int32")
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "ids": [own["vec_id"].to_numpy("int64").tobytes()], "labels": [own["label"].to_numpy("int64").tobytes()], "x": [_narrow(x).tobytes()], "lists": [order.tobytes()]})

    return written(dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, labels binary, x binary, lists binary"), "blocks", FILE_BLOCKS)


def _narrow(x: np.ndarray) -> np.ndarray:
    """x, whole numbers, in the fewest bytes that hold each of them."""
    least, most = x.min(initial=0), x.max(initial=0)
    for kind in ("<i1", "<i2", "<i4"):
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype("<f8")


def unpacked(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (ascending), labels and the matrix of a block."""
    ids = np.frombuffer(row["ids"], "<i8")
    kind = {1: "<i1", 2: "<i2", 4: "<i4"}.get(len(row["x"]) // max(1, len(ids) * row["dim"]), "<f8")
    return ids, np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["x"], kind).astype("float64").reshape(len(ids), -1)


def asked(rows: DataFrame, id_col: str, query_block: int | None = None) -> DataFrame:
    """Rows with an array `x` and the group of queries (dim, ask) that each belongs to: of query_block rows, or of QUERY_BLOCK and fewer where these have more than BLOCK_NUMBERS numbers."""
    return _dealt(rows, [id_col, "x"], "ask", lambda n, dim: n / query_block if query_block else F.greatest(n / QUERY_BLOCK, n * dim / BLOCK_NUMBERS))


def meet(blocks: DataFrame, queries: DataFrame, work: Callable[[pd.Series, pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    """work(block, queries) for every block and every group of queries (dim, ask, ...) of the same length.

    A block goes once to each group of queries, and each query once to each block.
    """
    n_blocks = blocks.groupBy("dim").agg((F.max("block") + 1).alias("__blocks"))
    n_asks = queries.groupBy("dim").agg((F.max("ask") + 1).alias("__asks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = blocks.join(F.broadcast(n_asks), "dim").withColumn("ask", upto("__asks")).drop("__asks")
    right = queries.join(F.broadcast(n_blocks), "dim").withColumn("block", upto("__blocks")).drop("__blocks")

    def run(key: tuple, own: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        if own.empty or those.empty:
            return work(None, those.iloc[:0])
        return work(own.iloc[0], those)

    keys = ["dim", "ask", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, ddl)

"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks; in a block each dimension has a list of rows sorted by value, made once and
written with it. A query walks all lists in step from the end that its component favours. Rows that a
list shows for the first time are scored in full; the sum over the lists of the query's component times
the value reached is a bound for every row not yet seen, and the walk ends when it is below the k-th best
score. Queries meet one block first; the k-th best score they find there goes with them to all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .common import passing_tables, written

#: Rows in a block of vectors, and in a block of queries.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048
#: Entries that a walk takes from each list at first; then twice as many each time.
FIRST_STEP = 16


class SortedLists:
    """A block of vectors with its per-dimension lists (places in ascending order of value)."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, rows: np.ndarray, lists: np.ndarray):
        self.ids, self.counts, self.rows, self.lists = ids, counts, rows, lists

    def top(self, query: np.ndarray, own_id: int, k: int, floor: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
        """The k best (score, id, count), ties to smaller ids, without own_id, and how many rows were scored; rows below `floor` need not be among them."""
        n, dims = self.rows.shape
        seen = self.ids == own_id
        own = int(seen.sum())
        best: list[tuple[int, int, int]] = []
        depth, step, up = 0, FIRST_STEP, query < 0
        used = np.flatnonzero(query)
        while depth < n:
            to = min(n, depth + step)
            heads = self.lists[depth:to]
            shown = np.where(up, heads, self.lists[n - to : n - depth][::-1]) if dims else np.arange(depth, to)[:, None]
            reached = np.zeros(n, bool)
            reached[shown[:, used] if len(used) else shown] = True
            new = np.flatnonzero(reached & ~seen)
            seen |= reached
            if len(new):
                score = vectors.scores(self.rows[new], query[None, :])[:, 0]
                if len(new) > k:
                    least = np.partition(score, len(new) - k)[len(new) - k]
                    new, score = new[score >= least], score[score >= least]
                best = sorted([*best, *((int(s), int(self.ids[i]), int(self.counts[i])) for s, i in zip(score, new, strict=True))], key=lambda x: (-x[0], x[1]))[:k]
            kth = [s for s, _, _ in best[k - 1 : k]] + [floor] * (floor is not None)
            if kth and dims:
                last = self.rows[np.where(up, self.lists[to - 1], self.lists[n - to]), np.arange(dims)]
                if vectors.clamped(sum(int(v) * int(q) for v, q in zip(last[used], query[used], strict=True))) < max(kth):  # an unseen row that ties might have a smaller id
                    break
            depth, step = to, 2 * step
        return best, int(seen.sum()) - own


def _walked(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, times, vec_id, score, n, scored) of the k best rows of each block for each query (query_id, x, times, floor)."""
    columns = ["query_id", "times", "vec_id", "score", "n", "scored"]

    def work(block: pd.Series | None, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, ...]] = []
        if len(asked):
            ids, counts, x = vectors.unpacked(block)
            table = SortedLists(ids, counts, x, np.frombuffer(block["lists"], "<i4").reshape(x.shape))
            for q, own, times, floor in zip(asked["query_id"], asked["x"], asked["times"], asked["floor"], strict=True):
                best, scored = table.top(np.asarray(own), q, k, None if pd.isna(floor) else int(floor))
                out += [(q, times, i, s, n, scored) for s, i, n in best]
        return pd.DataFrame(out, columns=columns).astype("int64")

    return vectors.meet(blocks, queries, work, ", ".join(f"{c} long" for c in columns))


def walks(rows: DataFrame, query_every: int = 50, k: int = 5, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, times, vec_id, score, n, scored): of each block the k best candidates of every query, n and times as often as they and the query are repeated; scored: the rows of that block that the query's walk scored. Rows of a block known to be worse than the k best may be missing. Written."""
    known = vectors.scaled(rows).groupBy("vec_id", "x").agg(F.count("*").alias("label"))
    with passing_tables(rows.sparkSession) as keep:
        blocks = vectors.packed(known, lists=True, number=lambda n, dim: n / vector_block)
        queries = known.where(F.pmod("vec_id", F.lit(query_every)) == 0).select(F.col("vec_id").alias("query_id"), "x", F.col("label").alias("times"))
        queries = written(vectors.asked(queries, "query_id", query_block), "queries")
        first = written(_walked(blocks.where("block = 0"), queries.withColumn("floor", F.lit(None).cast("decimal(19)")), k), "first")
        nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        floors = first.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == k).select("query_id", F.col("score").cast("decimal(19)").alias("floor"))  # exact where pandas has nulls
        others = _walked(blocks.where("block > 0"), queries.join(floors, "query_id", "left"), k)
        return keep(first.unionByName(others), "walks")


def top_k(rows: DataFrame, query_every: int = 50, k: int = 5, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row whose vec_id divides by query_every.

    Candidates: every row of the same length with another vec_id. All are given if there are fewer than
    k. Rows with a null id, a null vector, or null or non-finite components take no part; rows that
    repeat an id are candidates (and queries) as often, each with a rank of its own, as in ORACLE. Scores
    are exact; one beyond 64 bits is given and ranked as the nearest long. An empty table gives an empty result.
    """
    found = walks(rows, query_every, k, vector_block, query_block)
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") * F.col("times"), F.lit(k).cast("long")))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

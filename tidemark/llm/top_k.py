"""Exact top-k search by inner product with MaxScore.

Vectors are rows of small integers; a query's terms are its components.  A term's contribution is
counted from the least it can be, so that it is never negative and has an upper bound in each shard.
Terms go by bound: as long as the bounds of the last ones together cannot lift a row over the k-th
best score, these are not essential.  Essential postings are traversed for all rows of a shard; the
others are probed, the largest bound first, only for rows that still can be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: Rows of a shard, about; queries that meet it at a time; what a vector's components are multiplied with.
SHARD, QUERIES, SCALE = 16384, 512, 64
#: Integers up to this size are exact in double precision; sums up to this fit into 64 bits whatever their order.
EXACT, LONG = 1 << 53, 1 << 62


def as_integers(column: str) -> Column:
    """floor(SCALE * x) of each component; null for a vector that is null or has a null or non-finite component.

    An error for a component that does not fit into 62 bits.
    """
    x = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(x, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.exists(x, lambda x: F.abs(x) >= float(LONG // SCALE))
    whole = F.transform(x, lambda x: F.floor(F.lit(float(SCALE)) * x))
    return F.when(F.col(column).isNotNull() & ~bad, F.when(~large, whole).otherwise(F.raise_error(F.lit("a component does not fit into 62 bits")).cast("array<bigint>")))


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of one width; missing components are 0, further ones are left out."""
    rows = [r[:width] for r in rows]
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(rows), width), np.int64)
    out[np.repeat(np.arange(len(rows)), lens), np.concatenate([np.arange(n) for n in lens]) if len(rows) else []] = np.concatenate(rows) if len(rows) else []
    return out


class Shard:
    """Rows with their postings, term by term, and each term's bounds; ids are sorted."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.ids, self.width, self.largest = ids, rows.shape[1], int(np.abs(rows).max(initial=0))
        self.rows = rows
        self.terms = {np.int64: np.ascontiguousarray(rows.T)}
        self.low, self.high = self.terms[np.int64].min(1), self.terms[np.int64].max(1)

    def fits(self, query: np.ndarray, most: int) -> bool:
        """Whether all partial sums of a query with the rows, and their bounds, are below ``most``."""
        return 2 * int(np.abs(query).max(initial=0)) * self.largest * max(1, self.width) < most

    def postings(self, queries: np.ndarray) -> np.ndarray:
        """In double precision where every sum is exact in it."""
        kind = np.float64 if self.fits(queries, EXACT) else np.int64
        if kind not in self.terms:
            self.terms[kind] = self.terms[np.int64].astype(kind)
        return self.terms[kind]


def _plain(query: np.ndarray, qid: int, shard: Shard, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A query whose sums with a shard may not fit into 64 bits, in whole numbers of any size; an error if one of the k best scores does not."""
    own = [int(x) for x in query]
    found = sorted((-sum(a * b for a, b in zip(own, row, strict=True)), i) for i, row in zip(shard.ids.tolist(), shard.rows.tolist(), strict=True) if i != qid)[:k]
    if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in found):
        raise ValueError("a score does not fit into 64 bits")
    return qid, np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64)


def best(queries: np.ndarray, qids: np.ndarray, shard: Shard, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, ids and scores of a shard's best k rows other than its own, ties to smaller ids."""
    short = np.array([shard.fits(q, LONG) for q in queries], bool)
    for q, qid in zip(queries[~short], qids[~short].tolist(), strict=True):
        yield _plain(q, qid, shard, k)
    queries, qids = queries[short], qids[short]
    terms, ids = shard.postings(queries), shard.ids
    kind = terms.dtype
    low, high = shard.low.astype(kind), shard.high.astype(kind)
    for q, qid in zip(queries.astype(kind), qids.tolist(), strict=True):
        ends = q * low, q * high
        least, bound = np.minimum(*ends), np.abs(ends[1] - ends[0])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what terms from the i-th on can add
        base = least.sum()
        alive = np.flatnonzero(ids != qid)
        if not len(alive):
            continue
        score = np.full(len(ids), base, kind)
        n = min(len(order), max(1, len(order) // 4))
        head, tail = order[:n], order[n:]
        score += q[head] @ terms[head] - least[head].sum()
        limit = None
        if len(alive) > k:
            # whole scores of the k rows that lead by now bound the k-th best from below
            top = alive[np.argpartition(-score[alive], k - 1)[:k]]
            limit = (score[top] + q[tail] @ terms[tail][:, top] - least[tail].sum()).min()
            essential = min(len(order), max(n, int(np.searchsorted(-(base + rest), -limit, "right"))))  # without these no row gets there
            more = order[n:essential]
            score += q[more] @ terms[more] - least[more].sum()
            n = essential
            alive = alive[score[alive] + rest[n] >= limit]
        while n < len(order):
            step = min(len(order), n + (8 if limit is not None else len(order)))
            more = order[n:step]
            score[alive] += q[more] @ terms[more][:, alive] - least[more].sum()
            n = step
            if limit is not None:
                if len(alive) > k:
                    limit = max(limit, -np.partition(-score[alive], k - 1)[k - 1])
                alive = alive[score[alive] + rest[n] >= limit]
        s = score[alive].astype(np.int64)
        lead = np.lexsort((ids[alive], -s))[:k]
        yield qid, ids[alive][lead], s[lead]


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row (id, v) of queries, the k best others of rows (id, v), v of integers.

    Each row goes to one shard of about SHARD rows, and the queries to all of them; a task holds one shard and
    lets QUERIES queries at a time pass.  Each shard gives k rows a query, which are merged.  Rows without id or
    vector take no part; rows with one id count each; fewer than k rows give all; vectors of unlike lengths are
    filled up with zeros; other columns are left out.  A score in a shard's k best that does not fit into 64
    bits is an error.  Empty tables give an empty table.
    """
    queries, rows = (x.where("id is not null and v is not null").select(F.col("id").cast("long"), F.col("v").cast("array<bigint>")) for x in (queries, rows))
    shards = max(1, -(-rows.count() // SHARD))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    given = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    asked = queries.select(every.alias("shard"), F.lit(True).alias("asks"), "id", "v")
    both = given.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, shard = None, [], None
        for batch in batches:
            at, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at[a] != place:
                    place, held, shard = at[a], [], None
                ids, vectors = batch.column("id").slice(a, b - a).to_numpy(), [np.asarray(v.values, np.int64) for v in batch.column("v").slice(a, b - a)]
                if not asks[a]:
                    held.append((ids, vectors))
                    continue
                if held:
                    found = [v for x in held for v in x[1]]
                    shard, held = Shard(_matrix(found, max(1, *map(len, found), 1)), np.concatenate([x[0] for x in held])), []
                for i in range(0, len(ids) if shard else 0, QUERIES):
                    out: list[list] = [[], [], []]
                    for qid, other, scores in best(_matrix(vectors[i : i + QUERIES], shard.width), ids[i : i + QUERIES], shard, k):
                        for x, y in zip(out, (np.full(len(other), qid), other, scores), strict=True):
                            x.append(y)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    met = both.mapInArrow(meet, "query_id long, vec_id long, score long")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), as_integers("embedding").alias("v"))
    return top_k(vectors.where("id % 20 = 0"), vectors, 20)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

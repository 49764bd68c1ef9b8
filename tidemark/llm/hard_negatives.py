"""Hard negatives by threshold joins with suffix norms.

Rows of a shard have their dimensions in blocks, those of the largest values first.  A block's postings are in the
order of the rows' norms from that block on.  For a threshold, a query reads only the head of each block's postings:
a row's further dimensions are left out as soon as the product of both suffix norms is below the threshold, as they
cannot lift the row over it by themselves.  A row whose partial score and remaining norms reach the threshold is
scored in full.  Thresholds fall step by step, and each step only reads what comes on at the postings' heads, until
enough rows are found: the best rows of the anchor's label first, then, from all shards' best of these, the windows
of scores that are filled with rows of other labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

#: Rows of a shard, about; dimensions of a block; what a component is multiplied with.
SHARD, BLOCK, SCALE = 16384, 8, 256
#: Positives of an anchor and negatives of a positive; a negative has from LOW to HIGH hundredths of its positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Whole numbers up to this are exact in double precision.
EXACT = 2.0**53
#: Thresholds of positives fall to these parts of the largest possible score; each of negatives to so much of the last.
STEPS, FALL = (0.9, 0.75, 0.6, 0.45, 0.3, 0.15), 0.85


def as_whole(column: str) -> Column:
    """floor(SCALE * x) of each component x, as doubles; null for a vector that is null or has a null or non-finite component."""
    x = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(x, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(x, lambda x: F.lit(float(SCALE)) * x)  # from EXACT on all doubles are whole
    return F.when(F.col(column).isNotNull() & ~bad, F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)))


class Shard:
    """Rows with ids, labels and postings in blocks of dimensions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.dims = np.argsort(-np.abs(rows).sum(0), kind="stable")  # the largest first
        self.cuts = range(0, max(1, rows.shape[1]), BLOCK)
        ordered = rows[:, self.dims]
        squares = np.cumsum((ordered**2)[:, ::-1], axis=1)[:, ::-1]
        self.norms = [np.sqrt(squares[:, i]) * (1 + 1e-9) if rows.shape[1] else np.zeros(len(ids)) for i in self.cuts]
        self.order = [np.argsort(-norm, kind="stable") for norm in self.norms]
        self.heads = [norm[order] for norm, order in zip(self.norms, self.order, strict=True)]
        self.postings = [np.ascontiguousarray(ordered[order, i : i + BLOCK]) for i, order in zip(self.cuts, self.order, strict=True)]


class Search:
    """One query's way through a shard: what it has read of each block's postings, and the partial scores."""

    def __init__(self, shard: Shard, query: np.ndarray):
        self.shard, self.query = shard, query
        self.own = query[shard.dims]
        squares = np.append(np.cumsum((self.own**2)[::-1])[::-1], 0)
        self.norms = [float(np.sqrt(squares[i])) * (1 + 1e-9) for i in shard.cuts]
        self.read, self.partial = [0] * len(shard.order), np.zeros(len(shard.ids))
        self.blocks = np.zeros(len(shard.ids), np.int64)  # of each row, how many were read
        self.left = shard.norms[0] * self.norms[0]  # what the unread blocks of a row can still give
        self.largest = float(self.left.max(initial=0))

    def above(self, threshold: float, wanted: np.ndarray) -> np.ndarray:
        """The wanted rows whose score is at least the threshold, which may only fall from call to call."""
        shard = self.shard
        for i, order in enumerate(shard.order):
            # a row's block is read if its norms from there on could reach the threshold
            bound = threshold / self.norms[i] if self.norms[i] else np.inf
            n = len(order) if threshold <= 0 else int(np.searchsorted(-shard.heads[i], -bound, "right"))
            if n <= self.read[i]:
                continue
            rows = order[self.read[i] : n]
            self.partial[rows] += shard.postings[i][self.read[i] : n] @ self.own[i * BLOCK : (i + 1) * BLOCK]
            self.blocks[rows] = i + 1
            self.left[rows] = shard.norms[i + 1][rows] * self.norms[i + 1] if i + 1 < len(shard.norms) else 0
            self.read[i] = n
        return np.flatnonzero(wanted & (self.partial + self.left >= threshold))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Whole scores: partial ones are exact, so only rows with unread blocks need more."""
        out = self.partial[rows].copy()
        rest = np.flatnonzero(self.blocks[rows] < len(self.shard.order))
        out[rest] = self.shard.rows[rows[rest]] @ self.query
        return out


def best(search: Search, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k wanted rows with the highest scores, ties to smaller ids."""
    for step in (*STEPS, None):
        threshold = -np.inf if step is None else step * search.largest
        rows = search.above(threshold, wanted)
        if len(rows) < k and step is not None:
            continue
        score = search.scores(rows)
        enough = score >= threshold
        if enough.sum() >= k or step is None:
            rows, score = rows[enough], score[enough]
            first = np.lexsort((search.shard.ids[rows], -score))[:k]
            return rows[first], score[first]
    raise AssertionError("the last step has no threshold")


def windowed(search: Search, wanted: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high), places and scores of the k best wanted rows with low <= score <= high."""
    open_ = [w for w in windows if w[0] <= w[1]]
    if not open_:
        return [(np.zeros(0, np.int64), np.zeros(0))] * len(windows)
    end, threshold = min(w[0] for w in open_), max(w[1] for w in open_)
    while True:
        threshold = max(end, threshold * FALL) if threshold > 1 else end
        rows = search.above(threshold, wanted)
        score = search.scores(rows)
        if threshold <= end or all(np.count_nonzero((score >= max(low, threshold)) & (score <= high)) >= k for low, high in open_ if low < threshold):
            break
    first = np.lexsort((search.shard.ids[rows], -score))
    rows, score = rows[first], score[first]
    out = []
    for low, high in windows:
        # below the threshold not all rows are known; a window that reaches down there has k rows above
        at = np.flatnonzero((score >= max(low, threshold)) & (score <= high))[:k]
        out.append((rows[at], score[at]))
    return out


class Rows:
    """A shard's rows: those whose products with each other are exact in double precision, and longer ones in whole numbers."""

    def __init__(self, ids: list[np.ndarray], labels: list[np.ndarray], vectors: list[np.ndarray]):
        self.ids, self.labels = np.concatenate(ids), np.concatenate(labels)
        self.width = max(map(len, vectors))
        self.limit = (EXACT / max(1, self.width)) ** 0.5
        long = np.array([np.abs(v).max(initial=0) > self.limit for v in vectors])
        self.vectors, self.long, self.short = vectors, np.flatnonzero(long), np.flatnonzero(~long)
        rows = np.zeros((len(self.short), self.width))
        for i, at in enumerate(self.short.tolist()):
            rows[i, : len(vectors[at])] = vectors[at]
        self.shard = Shard(self.ids[self.short], self.labels[self.short], rows)

    def whole(self, query: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of rows, in whole numbers of any size."""
        own = [int(x) for x in query]
        return [(sum(a * int(b) for a, b in zip(own, self.vectors[i].tolist(), strict=False)), int(self.ids[i])) for i in rows.tolist()]

    def found(self, query: np.ndarray, wanted: np.ndarray, windows: list[tuple[int, int]] | None, k: int) -> list[list[tuple[int, int]]]:
        """For each window, or for one without ends if None, (score, id) of the k best wanted rows, the best first."""
        ends = windows if windows is not None else [(None, None)]
        short = np.abs(query).max(initial=0) <= self.limit
        slow = self.whole(query, np.flatnonzero(wanted) if not short else self.long[wanted[self.long]])
        out = [[x for x in slow if (low is None or low <= x[0]) and (high is None or x[0] <= high)] for low, high in ends]
        if short and len(self.short):
            own = np.zeros(self.width)
            own[: len(query)] = query[: self.width]
            search, wanted = Search(self.shard, own), wanted[self.short]
            # scores of short vectors are below EXACT, and so may the ends be
            near = [(float(max(low, -EXACT)), float(min(high, EXACT))) for low, high in ends] if windows is not None else None
            fast = [best(search, wanted, k)] if near is None else windowed(search, wanted, near, k)
            for held, (rows, scores) in zip(out, fast, strict=True):
                held += zip(scores.astype(np.int64).tolist(), self.shard.ids[rows].tolist(), strict=True)
        return [sorted(held, key=lambda x: (-x[0], x[1]))[:k] for held in out]


def _fits(score: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise ValueError(f"a score of {score} does not fit into 64 bits")
    return score


def _met(rows: DataFrame, asked: DataFrame, answer: Callable[[Rows, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """What answer gives for each row of asked in each shard of rows; a task holds one shard and lets the rows of asked pass."""
    shards = max(1, -(-rows.count() // SHARD))
    given = rows.withColumns({"shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"), "asks": F.lit(False)})
    asked = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "asks": F.lit(True)})
    both = given.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, own = None, [], None
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            at, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at[a] != place:
                    place, held, own = at[a], [], None
                part = batch.slice(a, b - a)
                vectors = [np.asarray(v.values, np.float64) for v in part.column("v")]
                if not asks[a]:
                    held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), vectors))
                    continue
                if held:
                    own, held = Rows([x[0] for x in held], [x[1] for x in held], [v for x in held for v in x[2]]), []
                if own is None:
                    continue
                others = [c for c in part.schema.names if c not in ("v", "shard", "asks")]
                out = [row for query, v in zip(part.select(others).to_pylist(), vectors, strict=True) for row in answer(own, query | {"v": v})]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c == "place" else pa.int64()) for c, x in zip(names, zip(*out, strict=True), strict=True)], names=names)

    return both.mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows and anchors (id, label, v).

    v is a vector of whole numbers, as doubles; a score is the inner product.  An anchor's positives are the
    ``positives`` best other rows of its label; for each, its negatives are the ``negatives`` best rows of other
    labels that have from ``low`` to ``high`` hundredths of the positive's score, none if that is negative.  Ties
    go to smaller ids; fewer rows give all.

    Rows without id, label or vector take no part.  Rows with one id count each, but none of them is a positive of
    an anchor of this id; of anchors with one id the one with the smallest label, then vector, counts.  Vectors of
    unlike lengths are filled up with zeros.  A score in the result that does not fit into 64 bits is an error.
    Other columns are left out; empty tables give an empty table.
    """
    rows, anchors = (x.where("id is not null and label is not null and v is not null").select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>")) for x in (rows, anchors))
    anchors = written(anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("own")).select("id", "own.*"), "anchors")

    def nearest(own: Rows, query: dict) -> Iterator[tuple]:
        for score, other in own.found(query["v"], (own.labels == query["label"]) & (own.ids != query["id"]), None, positives)[0]:
            yield query["id"], other, _fits(score)

    found = _met(rows, anchors, nearest, "id long, positive_id long, positive_score long")
    by = W.partitionBy("id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives)
    found = found.groupBy("id").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives"))
    asked = written(anchors.join(found, "id"), "positives")

    def between(own: Rows, query: dict) -> Iterator[tuple]:
        wanted = own.labels != query["label"]
        windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in query["positives"]]
        for p, negs in zip(query["positives"], own.found(query["v"], wanted, windows, negatives), strict=True):
            for score, other in negs:
                yield query["id"], p["place"], p["positive_id"], p["positive_score"], other, _fits(score)

    found = _met(rows, asked, between, "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    by = W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every vector whose id is divisible by 50; ids divisible by 7 have another label first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), as_whole("embedding").alias("v"))
    return hard_negatives(rows, rows.where("id % 50 = 0"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS other, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits: each is the majority of that bit in the hashes of a text's shingles.  All pairs of
distinct fingerprints at a Hamming distance of at most RADIUS are found by splitting the problem at a vantage
point: fingerprints nearer than some distance go inside, the others outside.  By the triangle inequality a pair
across the boundary has both ends within RADIUS of it, so besides the two halves there is one more problem, of the
inner shell against the outer one.  Problems of two sides are split the same way.

The top of the tree is fitted to a sample of fingerprints and deals all of them to shards, those near a boundary to
each shard that they may have a partner in; a shard goes on splitting in memory.  Which pairs are found does not
depend on the tree.  A shard gives links of a spanning forest only, so large groups cost no more than their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, small_batches, table, utf8, written
from .near_dup import components

#: Fingerprints that differ in no more bits are linked; seed of the shingles' hash.
RADIUS, SEED = 3, 42
#: Fingerprints that the top of the tree is fitted to, about; those of them that a branch has at least.
SAMPLE, FEW = 16384, 16
#: A shard has about LEAF fingerprints, or ROOT times the root of their number if that is more.
LEAF, ROOT = 4096, 16
#: Pairs that are compared one by one rather than split; vantage points and fingerprints tried for a split.
DIRECT, TRIED, LOOKED = 1 << 19, 4, 512
#: Parts that rows of one fingerprint are dealt to; shingles hashed together.
SALTS, TOGETHER = 32, 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def simhash(data: memoryview | bytes, ends: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers.

    Words are runs of other characters than white space, A-Z lower-cased; shingles are k of them joined by a space,
    all of a shorter text's; a bit is 1 if it is in over half of the shingles' XXH64.
    """
    n = len(ends) - 1
    counts, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    start, stop = inside & cut[:-1], inside & cut[1:]
    start[1:] |= inside[1:] & ~inside[:-1]
    stop[:-1] |= inside[:-1] & ~inside[1:]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    row = np.searchsorted(ends, start, "right") - 1
    # all words, each with one space behind it
    size = stop - start
    at = np.append(0, np.cumsum(size + 1))
    words = np.full(int(at[-1]), 32, np.uint8)
    words[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = raw[inside]
    words = words.tobytes()
    first, last = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right") - 1
    word = np.arange(len(row))
    begin = np.flatnonzero((word + k - 1 <= last[row]) | (word == first[row]))
    final = np.minimum(begin + k - 1, last[row[begin]])
    hash_of = xxhash.xxh64_intdigest
    for i in range(0, len(begin), TOGETHER):
        b, e = begin[i : i + TOGETHER], final[i : i + TOGETHER]
        found = np.fromiter((hash_of(words[x:y], SEED) for x, y in zip(at[b].tolist(), (at[e] + size[e]).tolist(), strict=True)), np.uint64, len(b))
        bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[b]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
        total[own[new]] += np.diff(np.append(new, len(b)))
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text); fp is the unsigned number's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(simhash(data, ends, k).view(np.int64))], names=["doc_id", "fp"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _distance(fp: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fp ^ point).astype(np.int64)


def _split(fp: np.ndarray, x: np.ndarray, y: np.ndarray | None) -> tuple[np.uint64, int] | None:
    """The vantage point and boundary that leave the fewest pairs of x with y (with itself if None); None if nearly all are left."""
    a = fp[x[:: -(-len(x) // LOOKED)]]
    b = a if y is None else fp[y[:: -(-len(y) // LOOKED)]]
    most, found = 0.9 * len(a) * len(b), None
    for point in np.concatenate([a[:: -(-len(a) // TRIED)], b[:: -(-len(b) // TRIED)] if y is not None else a[:0]]):
        ha, hb = (np.bincount(_distance(v, point), minlength=65) for v in (a, b))
        sa, sb = (np.concatenate([np.zeros(RADIUS + 1), np.cumsum(h), np.full(RADIUS, len(v))]) for h, v in ((ha, a), (hb, b)))  # s[d + RADIUS] are nearer than d
        for bound in range(1, 65):
            i = bound + RADIUS
            left = sa[i] * sb[i] + (len(a) - sa[i]) * (len(b) - sb[i]) + (sa[i] - sa[i - RADIUS]) * (sb[i + RADIUS] - sb[i])
            if y is not None:
                left += (sb[i] - sb[i - RADIUS]) * (sa[i + RADIUS] - sa[i])
            if left < most:
                most, found = left, (point, bound)
    return found


def _parts(fp: np.ndarray, x: np.ndarray, y: np.ndarray | None, point: np.uint64, bound: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """The problems that pairs of x with y go to: inside, outside, and across the boundary (in two ways if there are two sides)."""
    inner = lambda d: (d < bound) & (d >= bound - RADIUS)
    outer = lambda d: (d >= bound) & (d < bound + RADIUS)
    dx = _distance(fp[x], point)
    if y is None:
        return [(x[dx < bound], None), (x[dx >= bound], None), (x[inner(dx)], x[outer(dx)])]
    dy = _distance(fp[y], point)
    return [(x[dx < bound], y[dy < bound]), (x[dx >= bound], y[dy >= bound]), (x[inner(dx)], y[outer(dy)]), (x[outer(dx)], y[inner(dy)])]


@dataclass
class Branch:
    point: np.uint64
    bound: int
    parts: list[Branch | int]


class Top:
    """The top of the tree: its leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, n: int):
        self.shards, self.fp = 0, sample
        # as many pairs of the sample as a full shard has of all fingerprints
        self.full = (max(LEAF, ROOT * n**0.5) * len(sample) / max(1, n)) ** 2
        self.root = self._grown(np.arange(len(sample)), None)
        del self.fp

    def _grown(self, x: np.ndarray, y: np.ndarray | None) -> Branch | int:
        other = x if y is None else y
        split = _split(self.fp, x, y) if len(x) * len(other) > self.full and min(len(x), len(other)) >= FEW else None
        if split is None:
            self.shards += 1
            return self.shards - 1
        return Branch(*split, [self._grown(*part) for part in _parts(self.fp, x, y, *split)])

    def dealt(self, fp: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(shard, side, places) of fingerprints: side 0 meets itself, 1 meets 2."""
        todo: list[tuple[Branch | int, np.ndarray, np.ndarray | None]] = [(self.root, np.arange(len(fp)), None)]
        while todo:
            at, x, y = todo.pop()
            if isinstance(at, Branch):
                todo += [(part, *own) for part, own in zip(at.parts, _parts(fp, x, y, at.point, at.bound), strict=True)]
                continue
            if y is None:
                yield at, 0, x
            else:
                yield at, 1, x
                yield at, 2, y


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let a and b, pair by pair, have one parent, the least of their component (in place)."""
    while True:
        one, other = parent[a], parent[b]
        apart = one != other
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
        while (parent != (above := parent[parent])).any():
            parent[:] = above


def forest(fp: np.ndarray, x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    """For each fingerprint the least place in its component, by pairs of x with y (with itself if None)."""
    parent = np.arange(len(fp))
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        other = x if y is None else y
        if not len(x) or not len(other) or (parent[x] == parent[x[0]]).all() and (parent[other] == parent[x[0]]).all():
            continue
        split = _split(fp, x, y) if len(x) * len(other) > DIRECT else None
        if split is not None:
            todo += _parts(fp, x, y, *split)
            continue
        for i in range(0, len(x), 256):
            own, others = x[i : i + 256], x[i:] if y is None else y
            for j in range(0, len(others), 4096):
                near = np.bitwise_count(fp[own][:, None] ^ fp[others[j : j + 4096]][None, :]) <= RADIUS
                a, b = np.nonzero(near)
                if len(a):
                    _united(parent, own[a], others[j + b])
    return parent


def linked(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the rep of nodes (fp, rep), fp distinct, that connect all fingerprints within RADIUS."""
    n = nodes.count()
    chosen = nodes.where((F.xxhash64("fp").bitwiseAND(F.lit((1 << 63) - 1))) <= F.lit(min((1 << 63) - 1, int(SAMPLE / max(1, n) * 2.0**63))))
    sample = np.sort(np.array([r.fp for r in chosen.select("fp").collect()], np.int64)).view(np.uint64)
    top = Top(np.random.default_rng(0).permutation(sample), n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for shard, side, at in top.dealt(fp):
                if len(at):
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(np.full(len(at), side, np.int8)), own.column("fp"), own.column("rep")], names=["shard", "side", "fp", "rep"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = pa.Table.from_batches(held)
            side, fp, rep = (own.column(c).to_numpy() for c in ("side", "fp", "rep"))
            x, y = np.flatnonzero(side < 2), np.flatnonzero(side == 2) if side[0] else None
            parent = forest(fp.view(np.uint64), x, y)
            at = np.flatnonzero(parent != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[parent[at]])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            new = (np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist()
            for i, j in zip([0, *new], [*new, len(shard)], strict=True):
                if i == j:
                    continue
                if held and held[0].column("shard")[0].as_py() != shard[i]:
                    yield links(held)
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield links(held)

    rows = nodes.select("fp", "rep").mapInArrow(deal, "shard int, side byte, fp long, rep long")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(meet, "a long, b long")


def simhash_groups(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    The fingerprint of a text's shingles of ``k`` words (see ``simhash``) as 16 hexadecimal digits; a text that is
    null, empty or white space has that of zeros, which is linked like any other.  Texts whose fingerprints differ
    in at most RADIUS bits are linked; component_id is the smallest doc_id that links reach.  Rows with one doc_id
    are one document, which the texts of all of them link.  A row without doc_id is never linked, its component_id
    is null.  Equal rows have equal results; texts count whole; other columns are left out; an empty table gives an
    empty table.
    """
    rows = fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), k)
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "simhash")
    # a fingerprint that very many rows have is SALTS rows at most from here on
    dealt = written(rows.where("doc_id is not null").groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "dealt")
    nodes = written(dealt.groupBy("fp").agg(F.min("least").alias("rep")), "nodes")
    several = rows.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("doc_id is not null and low <> high").select("doc_id", "low")
    own = rows.select("doc_id", "fp").join(several, "doc_id").where("fp <> low").select("fp", "low").distinct()
    own = own.join(nodes, "fp").select("low", F.col("rep").alias("a")).join(nodes.select(F.col("fp").alias("low"), F.col("rep").alias("b")), "low").select("a", "b")
    comps = components(written(linked(nodes).unionByName(own), "simhash-links"))
    # a node is called after its least document, so the least node of a component is its least document
    found = nodes.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("fp", F.coalesce("comp", "rep").alias("component_id"))
    found = dealt.select("fp", "salt").join(found, "fp")
    out = rows.join(found, ["fp", "salt"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by SimHash on three words."""
    small_batches(spark)
    return simhash_groups(table(spark, sf_dir, "documents"))

"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit numbers make all coordinates of a signature: the first scatters a
document's shingles, the second is applied to them after a circular shift, another one for each
coordinate.  Equal sets become one node.  Nodes that agree on a band of coordinates are candidates;
whether they are linked is decided on their full sets.

A bucket with n nodes is never expanded into its pairs.  First all its nodes are compared with one of
them, then, in large buckets, those that are not in the bucket's largest component with several of that
component, and at last what still is apart is compared, in blocks, with all that it could be linked to.
Each step only leaves out pairs that already are in one component, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, shingles, small_batches, table, utf8, word_hashes, written

#: Bands of ROWS coordinates: at a similarity of 0.8, 1 of 3 * 10**5 pairs shares no band; at 0.85, 1 of 5 * 10**7.
BANDS, ROWS = 24, 4
WIDTH = BANDS * ROWS
#: In the last step, pairs that agree on fewer coordinates are left out: at a similarity of 0.8, about 1 of 10**6.
AGREE = 54
#: The bands are laid out for similarities from so many percent on.
LOWEST = 80
#: Nodes of the largest component that others are compared with in the second step; nodes in a block.
PIVOTS, BLOCK = 8, 512
#: Nodes of a bucket that the second step leaves to the last one; parts that a large component is joined in.
SMALL, SALTS = 32, 32


def _permute(v: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers (in place)."""
    v ^= v >> np.uint32(16)
    v *= np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(13)
    v *= np.uint32(0xC2B2AE35)
    v ^= v >> np.uint32(16)
    return v


def signature(found: np.ndarray) -> np.ndarray:
    """WIDTH minima of the second permutation, shifted by 1, 2, ..., over what the first makes of a set."""
    scattered = _permute((found >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1))
    shift = np.arange(1, WIDTH + 1, dtype=np.uint32)
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(scattered), 4096):
        np.minimum(out, _permute(scattered[i : i + 4096, None] + shift).min(0), out=out)
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature, and a hash of each band (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            words, at = word_hashes(data, ends)
            n, digest, sig, bands = [], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                found = shingles(words[a:b], k)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                own = signature(found) if len(found) else np.zeros(0, np.uint32)
                sig.append(own.tobytes())
                bands.append([int.from_bytes(hashlib.blake2b(own[i * ROWS : (i + 1) * ROWS].tobytes(), digest_size=8, salt=bytes([i])).digest(), "little", signed=True) for i in range(BANDS if len(own) else 0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sig", "bands"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The full set of each node (node, rep, digest), as sorted 64-bit hashes, from the text of rep that has this set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            words, at = word_hashes(data, ends)
            sets = [shingles(words[a:b], k).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            own = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(own), pa.array(sets, pa.binary()).filter(own)], names=["node", "set"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(nodes, "rep")
    return map_texts(texts, run, "node long, set binary").dropDuplicates(["node"])


def _jaccard(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least so many percent of their union in common."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("set"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return map_texts(pairs.join(b, "b").join(sets.withColumnRenamed("node", "a"), "a").select("a", "b", "set", "set_b"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of each node with a link; comp is the least node that it reaches.

    In each round all that a node is linked to downwards is linked to the least of them, and then each
    node to its parent's parent.  Ends when a round moves nothing; each is a table in the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        least = edges.groupBy("u").agg(F.min("v").alias("w"))
        hooks = edges.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"), F.lit(True).alias("moved"))
        hooked = least.select("u", F.col("w").alias("v"), F.lit(False).alias("moved")).unionByName(hooks).groupBy("u", "v").agg(F.bool_or("moved").alias("moved"))
        above = hooked.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w"))
        watch = Observation()
        stepped = hooked.join(above, "v", "left").withColumn("moved", F.col("moved") | F.col("w").isNotNull()).observe(watch, F.count_if("moved").alias("n"))
        edges = written(stepped.select("u", F.coalesce("w", "v").alias("v")), "components")
        if not watch.get["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _stars(comps: DataFrame) -> DataFrame:
    """Components as links again: what later steps add to, in fewer rounds than from all links."""
    return comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))


def _merged(links: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp, into) of components that links lead out of: the least that one of these leads to, which may be merged itself."""
    for end in ("a", "b"):
        own = comps.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
        links = links.join(own, end, "left").withColumn(f"comp_{end}", F.coalesce(f"comp_{end}", end))
    links = links.where("comp_a <> comp_b").select(F.greatest("comp_a", "comp_b").alias("comp"), F.least("comp_a", "comp_b").alias("into"))
    return links.groupBy("comp").agg(F.min("into").alias("into"))


def _placed(placed: DataFrame) -> DataFrame:
    """placed (bucket, node, comp) with its bucket's largest component (main), number of nodes, and of others; written.

    Only buckets with several components.
    """
    comp = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    largest = F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main")
    main = comp.groupBy("bucket").agg(largest, F.sum("n").alias("nodes"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    return written(placed.join(main, "bucket"), "placed")


def _star(placed: DataFrame) -> DataFrame:
    """Of buckets with over SMALL nodes, pairs of each node outside the largest component with some nodes of that component."""
    large = placed.where(F.col("nodes") > SMALL)
    pivots = large.where("comp = main").groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(PIVOTS))).agg(F.min("node").alias("a")).select("bucket", "a")
    return large.where("comp <> main").select("bucket", F.col("node").alias("b")).join(pivots, "bucket").select("a", "b").distinct()


class _Cells:
    """Tasks of the last step: a cell is a block of a bucket's nodes that meets a part of those outside its largest component.

    Rows (bucket, x, y, block, part, node, comp, sig[, set]) come sorted by cell; part is null in the largest component.
    """

    KEY = ("bucket", "x", "y")

    def __init__(self, percent: int, agree: int):
        self.percent, self.agree = percent, agree

    @staticmethod
    def rows(placed: DataFrame, sigs: DataFrame) -> DataFrame:
        count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        place = F.xxhash64("node")
        df = placed.withColumn("block", F.pmod(place, count("nodes")).cast("int")).withColumn("part", F.when(F.col("comp") != F.col("main"), F.pmod(place, count("others")).cast("int")))
        given = F.transform(F.sequence(F.lit(0), count("others") - 1), lambda y: F.struct(F.col("block").alias("x"), y.alias("y")))
        asked = F.transform(F.sequence(F.lit(0), count("nodes") - 1), lambda x: F.struct(x.alias("x"), F.col("part").alias("y")))
        df = df.withColumn("cells", F.when(F.col("part").isNull(), given).otherwise(F.array_union(given, asked)))
        return df.select("bucket", "node", "comp", "block", "part", "cells").join(sigs, "node").withColumn("cell", F.explode("cells")).select("bucket", "cell.x", "cell.y", "block", "part", "node", "comp", "sig")

    def _each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """One table for each cell."""
        held: list[pa.RecordBatch] = []
        key = lambda b, i: tuple(b.column(c)[i].as_py() for c in ("x", "y")) + tuple(b.column("bucket")[i].as_py().values())
        for batch in batches:
            cols = [batch.column("bucket").field(0).to_numpy(), batch.column("bucket").field(1).to_numpy(), batch.column("x").to_numpy(), batch.column("y").to_numpy()]
            new = (np.flatnonzero(np.any([k[1:] != k[:-1] for k in cols], axis=0)) + 1).tolist() if batch.num_rows > 1 else []
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                if a == b:
                    continue
                if held and key(held[0], 0) != key(batch, a):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)

    def _pairs(self, cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """node and comp of a cell's rows; of pairs that may be linked: both places and how many coordinates agree.

        A pair in several buckets is looked at in the first of them, and once if both are outside the largest component.
        """
        first = {c: cell.column(c)[0].as_py() for c in ("bucket", "x", "y")}
        node, comp, block = (cell.column(c).to_numpy() for c in ("node", "comp", "block"))
        part = cell.column("part").combine_chunks().fill_null(-1).to_numpy()
        sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint32).reshape(len(node), WIDTH)
        given = np.flatnonzero(block == first["x"])
        out = []
        for i in np.flatnonzero(part == first["y"]).tolist():
            near = given[(comp[given] != comp[i]) & ((part[given] < 0) | (node[given] > node[i]))]
            same = sig[near] == sig[i]
            n = same.sum(1)
            ok = (n >= self.agree) & (same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == first["bucket"]["band"])
            out.append((np.full(int(ok.sum()), i), near[ok], n[ok]))
        i, j, n = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
        return node, comp, i, j, n

    def needed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that are in a pair that may be linked: their sets are to be fetched."""
        for cell in self._each(batches):
            *_, i, j, _ = self._pairs(cell)
            if len(i):
                yield from cell.take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()

    def links(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links by the rows' sets, likelier ones first; none between nodes that a cell has linked before."""
        for cell in self._each(batches):
            node, comp, i, j, n = self._pairs(cell)
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in cell.column("set")]
            top = np.unique(comp, return_inverse=True)[1]
            a, b = [], []
            for k in np.lexsort((j, i, -n)).tolist():
                x, y = int(i[k]), int(j[k])
                if top[x] != top[y] and _jaccard(sets[x], sets[y], self.percent):
                    top[top == top[y]] = top[x]
                    a.append(node[x])
                    b.append(node[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _rest(placed: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, agree: int) -> DataFrame:
    """Links of nodes outside their bucket's largest component with nodes of other components.

    First signatures meet in blocks of BLOCK nodes; then the nodes of pairs that may be linked meet with their sets.
    """
    cells = _Cells(percent, agree)
    rows = cells.rows(placed, sigs).repartition(*cells.KEY).sortWithinPartitions(*cells.KEY)
    schema = "bucket struct<band:int,hash:long>, x int, y int, block int, part int, node long, comp long, sig binary"
    needed = written(map_texts(rows, cells.needed, schema), "rest")
    rows = needed.join(sets, "node").select(*needed.columns, "set").repartition(*cells.KEY).sortWithinPartitions(*cells.KEY)
    return map_texts(rows, cells.links, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, agree: int = AGREE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    A document's set: its distinct ``k`` words in a row, A-Z lower-cased; with fewer words, all of them as
    one.  Documents are linked if 100 * intersection >= ``percent`` * union; component_id is the smallest
    doc_id that links reach, kept says whether it is the document's own.  A text that is null, empty or
    white space has an empty set and no link.  Rows with one doc_id are one document: the texts of all of
    them link it.  A row without doc_id is never linked: component_id is null and kept is true.  Other
    columns of docs are left out; equal rows have equal results; an empty table gives an empty table.

    ``percent`` is LOWEST or more, as the bands are made for that.  Of pairs that share a bucket, the last
    step leaves out those that agree on fewer than ``agree`` coordinates; 0 compares all of them.
    """
    if percent < LOWEST:
        raise ValueError(f"similarities under {LOWEST} percent need other bands, not {percent}")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sigs = written(signatures(docs, k), "signatures")
    full = sigs.where("doc_id is not null and n_shingles > 0")
    nodes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # texts of one doc_id are linked by it
    several = full.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id", "low")
    own = full.select("doc_id", "digest").join(several, "doc_id").where("digest <> low").select("low", "digest").distinct()
    at = nodes.select("digest", "node")
    own = own.join(at.withColumnRenamed("node", "b"), "digest").select(F.col("low").alias("digest"), "b").join(at.withColumnRenamed("node", "a"), "digest").select("a", "b")

    member = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select(F.struct("band", "hash").alias("bucket"), "node")
    shared = member.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot")
    member = written(member.join(shared, "bucket"), "buckets")
    sets = written(_sets(docs, nodes.join(member.select("node").distinct(), "node").select("node", "rep", "digest"), k), "sets")
    pairs = member.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    comps = components(written(own.unionByName(_linked(pairs, sets, percent)), "links-one"))
    placed = _placed(member.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")))
    some = written(_linked(_star(placed), sets, percent), "links-some")
    if not some.isEmpty():
        # salted, as one component may have a third of all nodes
        merged = _merged(some, comps).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(merged, ["comp", "salt"], "left")
        placed = _placed(placed.select("bucket", "node", F.coalesce("into", "comp").alias("comp")))
    rest = written(_rest(placed, nodes.select("node", "sig"), sets, percent, agree), "links-rest")
    if not (some.isEmpty() and rest.isEmpty()):
        comps = components(_stars(comps).unionByName(some).unionByName(rest))
    rooted = nodes.select("digest", "node", "rep").join(comps, "node", "left").select("digest", "rep", F.coalesce("comp", "node").alias("root"))
    rooted = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("digest", "component")
    out = sigs.select("doc_id", "n_shingles", "digest").join(rooted, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three words, 85 percent."""
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


#: The sets as lists of text, all pairs that share a shingle, and the closure of their links.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM w
), u AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)
"""

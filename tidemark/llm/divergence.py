"""Source divergence audit: how far the sources of a language are from each other, and by which terms.

Terms are counted in numpy, batch by batch, in buckets of length: up to 8 bytes are one unsigned 64-bit
number and up to 16 are two, sorted by radix; longer ones are sorted as bytes, each length by itself.
Runs of the sorted terms give counts and numbers of documents, which Spark sums up.

The divergence of two sources is a sum over all kept terms of their language, most of which neither has.
It comes from sparse counts: terms that only one of the two has are taken from histograms of their
probabilities, and those of both correct these, so a term costs only pairs of sources that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_texts, small_batches, table, utf8, written

#: Documents of a language that a kept term is in at least; terms of a source that are reported.
LEAST, MOST = 3, 200
#: Probabilities are whole multiples of one in so many; parts that a language's sources are dealt to.
UNIT, SALTS = 1_000_000_000, 16
#: Bytes of text that are packed and sorted together.
TOGETHER = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def radix_order(keys: list[np.ndarray], n: int) -> np.ndarray:
    """The stable order of n rows by unsigned 64-bit keys, the least significant first: 16 bits at a time."""
    order = np.arange(n)
    for key in keys:
        for shift in (0, 16, 32, 48):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if n and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16 bits
    return order


def _buckets(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of lengths: the places of its terms in sorted order, and whether each is another term than the one before."""
    for low, high in ((1, 8), (9, 16)):
        at = np.flatnonzero((size >= low) & (size <= high))
        if not len(at):
            continue
        words = []
        for first in range(0, high, 8):
            word = np.zeros(len(at), np.uint64)
            for i in range(first, first + 8):
                inside = i < size[at]
                word = (word << np.uint64(8)) | np.where(inside, raw[np.where(inside, start[at] + i, 0)], 0).astype(np.uint64)
            words.append(word)
        order = radix_order(words[::-1], len(at))
        new = np.ones(len(at), bool)
        new[1:] = np.any([w[order][1:] != w[order][:-1] for w in words], axis=0)
        yield at[order], new
    for n in np.unique(size[size > 16]).tolist():
        at = np.flatnonzero(size == n)
        text = raw[start[at][:, None] + np.arange(n)].view(f"S{n}").ravel()  # no term has a zero byte
        order = np.argsort(text, kind="stable")
        new = np.ones(len(at), bool)
        new[1:] = text[order][1:] != text[order][:-1]
        yield at[order], new


def term_runs(data: memoryview | bytes, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, rows) of the terms of texts, which come in the order of their groups."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    if not len(raw):
        return
    inside = _LETTER[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    start = inside & cut[:-1]
    start[1:] |= inside[1:] & ~inside[:-1]
    stop = inside & cut[1:]
    stop[:-1] |= inside[:-1] & ~inside[1:]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    row, size = np.searchsorted(ends, start, "right") - 1, stop - start
    for at, new in _buckets(raw, start, size):
        own = row[at]
        other = new.copy()
        other[1:] |= own[1:] != own[:-1]  # equal terms are still in the order of their rows
        new[1:] |= group[own][1:] != group[own][:-1]
        first = np.flatnonzero(new)
        rows = np.add.reduceat(other.astype(np.int64), first)
        head = at[first]
        offsets = np.append(0, np.cumsum(size[head]))
        text = raw[np.repeat(start[head] - offsets[:-1], size[head]) + np.arange(offsets[-1])]
        term = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
        yield group[own][first], term, np.diff(np.append(first, len(at))), rows


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text); a row without term for each lang and source.

    Each row is a document.  A null counts as ''; a term is a longest run of letters A-Z and a-z and characters
    from U+0080 on, with A-Z lower-cased.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            names = sorted(set(keys))
            number = {k: i for i, k in enumerate(names)}
            group = np.fromiter((number[k] for k in keys), np.int64, len(keys))
            order = np.argsort(group, kind="stable")
            data, ends = utf8(batch.column("text").take(pa.array(order)))
            group = group[order]
            lang, source = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))

            def out(g: np.ndarray, term: pa.Array, n: np.ndarray, rows: np.ndarray, lang: pa.Array = lang, source: pa.Array = source) -> pa.RecordBatch:
                at = pa.array(g)
                return pa.RecordBatch.from_arrays([lang.take(at), source.take(at), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(rows, pa.int64())], names=["lang", "source", "term", "n", "docs"])

            zero = np.zeros(len(names), np.int64)
            yield out(np.arange(len(names)), pa.array([None] * len(names), pa.string()), zero, zero)
            first = 0
            while first < len(group):  # whole rows of about TOGETHER bytes
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOGETHER, "right")) - 1)
                for found in term_runs(data[int(ends[first]) : int(ends[last])], ends[first : last + 1] - ends[first], group[first:last]):
                    yield out(*found)
                first = last

    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return map_texts(docs, run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exact; null where there are no terms."""
    below = f"nullif(CAST({total} + {terms} AS DECIMAL(20, 0)), CAST(0 AS DECIMAL(20, 0)))"
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10, 0)) * (CAST({n} AS DECIMAL(19, 0)) + 1) div {below}")


def _far(p: str, q: str) -> Column:
    """floor((p - q) * (p - q) / q); both are at most UNIT + 1, so all of it fits into 64 bits."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _both_ways(df: DataFrame) -> DataFrame:
    """Values (lang, source, item, value) from sums (lang, source, item, ahead, back) that are computed together."""
    way = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    ways = F.array(way("source", "item", "ahead"), way("item", "source", "back"))
    return df.select("lang", F.explode(ways).alias("way")).select("lang", "way.*")


def divergence(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text), in whole numbers.

    Each language keeps the terms (see ``term_counts``) that are in at least ``least`` of its rows.  A source of
    a language, and the language itself, gives a kept term the probability p = 1 + floor(UNIT * (n + 1) / (N + V)),
    n its occurrences there, N those of all V kept terms.  p lies floor((p - q) ** 2 / q) from q.  Part ``pair``
    sums that over all kept terms for each other source of the language, whose p is q; 0 without kept terms.
    Part ``term`` has the ``most`` terms which a source has and that are likelier there than in the language,
    by their distance.  Ranks go by value, the largest first, then by item in the order of its bytes.

    Null lang, source or text count as ''; a source whose texts are null or without terms has its pairs, and
    no terms.  Each row is a document, repeated ones too; texts count whole.  Other columns are left out; an
    empty table gives an empty table.
    """
    counts = written(term_counts(docs), "term-counts")
    of_term = W.partitionBy("lang", "term")
    kept = counts.where("term is not null").withColumns({"in_docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term), "head": F.min("source").over(of_term)})
    kept = written(kept.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "all_n", (F.col("source") == F.col("head")).alias("head")), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count_if("head").alias("terms"), F.sum("n").alias("all_total"))
    sources = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = {"terms": 0, "all_total": 0, "total": 0, "own": 0}
    sources = counts.where("term is null").select("lang", "source").join(langs, "lang", "left").join(sources, ["lang", "source"], "left").na.fill(zero)
    sources = written(sources.withColumn("p0", _p("0", "total", "terms")), "sources")

    here = kept.join(sources, ["lang", "source"]).select("lang", "source", "term", _p("n", "total", "terms").alias("p"), _p("all_n", "all_total", "terms").alias("q"), "p0")
    here = written(here, "probabilities")
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = here.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)

    # every other source of a language, its rows dealt to SALTS parts
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    others = sources.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("item_own"), salts.alias("salt"))
    salted = lambda df, *by: df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    far = lambda p, q: F.coalesce(_far(p, q), F.lit(0))
    # all kept terms as if none were in either source; those in one or both are taken off ...
    none = salted(sources, "source").join(others, ["lang", "salt"]).where("source <> item")
    none = none.select("lang", "source", "item", ((F.col("terms") - F.col("own") - F.col("item_own")) * far("p0", "q0")).alias("value"))
    # ... and come in from the histogram of the source that has them ...
    bins = here.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    one = salted(bins, "source", "p").join(others, ["lang", "salt"]).where("source <> item")
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _far("p", "q0")).alias("ahead"), F.sum(F.col("m") * _far("q0", "p")).alias("back"))
    # ... which is mended for the terms that both have
    a, b = here.select("lang", "term", "source", "p", "p0"), here.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = a.join(b, ["lang", "term"]).where("source < item")
    mend = lambda p, q, p0, q0: F.sum(_far(p, q) - _far(p0, q) - _far(p, q0) + _far(p0, q0))
    both = both.groupBy("lang", "source", "item").agg(mend("p", "q", "p0", "q0").alias("ahead"), mend("q", "p", "q0", "p0").alias("back"))

    pairs = none.unionByName(_both_ways(one)).unionByName(_both_ways(both))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of all documents' sources."""
    small_batches(spark)
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), s AS (
  SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
  LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON a.lang = f.lang AND a.source = f.source AND b.source = f.item
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""

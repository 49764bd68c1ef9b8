"""Document fingerprints by order MinHash, with DataFrame operations only.

A text's k-mers of words are numbered by occurrence, so that repeats count.  A hash deals the numbered
k-mers to bins; in each bin the least ones are selected, put back into text order, and hashed together.
Two texts agree on a bin only if they share its least k-mers in the same order: likeness falls with the
edit distance, not only with the sets' difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

#: Words are cut after 16 characters, so that text without spaces has k-mers as well.
PIECE = r"[^\x20\x09-\x0D]{1,16}"
#: Words of a k-mer; k-mers selected in a bin; bits of a bin's number.
K, LEAST, BIN_BITS = 3, 2, 5
#: A hashed k-mer and its place share a 64-bit number: the low bits are the place; a text with more words is an error.
PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1
_NULL = -(1 << 63)


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~PLACE))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _let(value: Column, use) -> Column:
    """use(value), value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column) -> Column:
    """An array of (bin and tuple hash) texts, one for each bin that has a k-mer; empty for an empty text.

    Fewer than K words count as one k-mer.  Equal texts have equal arrays.  PLACE words or more (67 million) raise an error.
    """
    words = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x))

    def kmers(w: Column) -> Column:
        many = F.transform(F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - (K - 1))), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, K))))
        return F.when(F.size(w) >= PLACE, F.raise_error(F.lit("text too long for a fingerprint")).cast("array<bigint>")).when(F.size(w) >= K, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    def numbered(s: Column) -> Column:
        """The k-mers, sorted, hashed with their numbers among equal ones."""
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (_hash(F.get(s, i - 1)) != _hash(F.get(s, i))))

        def count(c: Column) -> Column:
            runs = F.flatten(F.transform(c, lambda x, i: F.sequence(F.lit(1), F.coalesce(F.get(c, i + 1), F.size(s)) - x)))
            return F.when(F.size(c) < F.size(s), runs)

        dealt = lambda o: F.transform(s, lambda x, i: _hash(F.xxhash64(_hash(x), F.coalesce(F.get(o, i), F.lit(1)))).bitwiseOR(x.bitwiseAND(PLACE)))
        return F.when(F.size(s) > 0, _let(_let(first, count), dealt)).otherwise(s)

    def entries(k: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            other = F.get(k, i + 1)
            both = F.when(_bin(other) == _bin(x), other)
            swap = both.bitwiseAND(PLACE) < x.bitwiseAND(PLACE)
            value = F.when(both.isNull(), F.xxhash64(_hash(x))).when(swap, F.xxhash64(_hash(both), _hash(x))).otherwise(F.xxhash64(_hash(x), _hash(both)))
            text = F.concat(F.lpad(F.hex(_bin(x) + (1 << BIN_BITS - 1)), 2, "0"), F.substring(F.lpad(F.hex(value), 16, "0"), 1, 8))
            return F.when((i == 0) | (_bin(F.get(k, i - 1)) != _bin(x)), F.lower(text))

        return F.filter(F.transform(k, entry), lambda x: x.isNotNull())

    least = lambda e: F.filter(e, lambda x, i: (i < LEAST) | (_bin(F.get(e, i - LEAST)) != _bin(x)))
    placed = _let(_let(words, kmers), lambda k: F.sort_array(F.transform(k, lambda x, i: _hash(x).bitwiseOR(i.cast("bigint")))))
    return _let(_let(F.sort_array(_let(placed, numbered)), least), entries)


def likeness(a: str, b: str) -> Column:
    """The share of bins that have k-mers in either text, and the same ones in the same order in both; 1 for two empty texts."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.substring(x, 1, 2)), F.transform(b, lambda x: F.substring(x, 1, 2))))
    return F.when(bins == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / bins)


def following(keys: DataFrame) -> DataFrame:
    """keys (rid, h, ..) with nrid and nh, the next in descending order of rid; after the last comes the first.

    Rows are dealt to ranges of about equal numbers of them, whatever their ids; each range is put in order,
    and its last row is followed by the first of the next range.
    """
    order = (F.desc("rid"), F.asc("h"))
    keys = written(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "fingerprint-ranges")
    lead = F.lead(F.struct("rid", "h")).over(W.partitionBy("range").orderBy(*order))
    # -1 - rid and h grow in the order of rows
    heads = keys.groupBy("range").agg(F.min(F.struct(F.expr("~rid").alias("down"), "h")).alias("top")).select("range", F.struct(F.expr("~top.down").alias("rid"), F.col("top.h").alias("h")).alias("head"))
    ranges = W.orderBy("range")  # one row for each range
    heads = heads.select("range", F.coalesce(F.lead("head").over(ranges), F.first("head").over(ranges)).alias("head"))
    out = keys.withColumn("lead", lead).join(heads, "range").withColumn("next", F.coalesce("lead", "head"))
    return out.withColumns({"nrid": F.col("next.rid"), "nh": F.col("next.h")}).drop("range", "lead", "head", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of docs (doc_id, text): fingerprints of text and edited text, and likenesses.

    Null text counts as empty.  Rows without doc_id come last in order; rows with one doc_id are ordered
    by a hash of the text; equal rows are one document and have equal results.  A single document is its
    own next one.  An empty table gives an empty table.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("rid"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    chain = written(following(docs.select("rid", "h", third.alias("third")).distinct()), "fingerprint-order")
    asked = chain.select(F.col("rid").alias("qrid"), F.col("h").alias("qh"), "third", F.col("nrid").alias("rid"), F.col("nh").alias("h"))
    heads = docs.join(asked, ["rid", "h"]).select(F.col("qrid").alias("rid"), F.col("qh").alias("h"), F.expr("substring(text, 1, third)").alias("start")).dropDuplicates(["rid", "h"])
    both = docs.join(heads, ["rid", "h"])
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), "start"))
    made = written(both.select("rid", "h", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("f"), fingerprint(F.col("edited")).alias("g")), "fingerprints")
    after = made.select(F.col("rid").alias("nrid"), F.col("h").alias("nh"), F.col("f").alias("next")).dropDuplicates(["nrid", "nh"])
    after = chain.select("rid", "h", "nrid", "nh").join(after, ["nrid", "nh"]).select("rid", "h", "next")
    out = made.join(after, ["rid", "h"])
    return out.select(
        F.when(F.col("rid") > _NULL, F.col("rid")).alias("doc_id"), "n_chars", "edited_sha256",
        F.concat_ws("", "f").alias("fingerprint"), F.concat_ws("", "g").alias("edited_fingerprint"),
        likeness("f", "g").alias("near_edited"), likeness("f", "next").alias("near_next"),
    )


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they and its next one are."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))

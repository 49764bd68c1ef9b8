"""Mixing sources to target weights, with DataFrame operations only.

The words of a source, document after document, are packed into blocks of one length.  A mix is a sequence of output
shards with SHARD slots each.  How many slots of a shard each source has is a multinomial draw, given that over all shards
each source has as many as its target asks for: one pseudorandom permutation deals all sources' slots to shards.  From
shard to shard a source's counts number its slots; these map to its blocks through permutations of its own, one for each
pass over the source, and blocks join by index.  So a draw decides in which shard each block is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, table, written

#: Words in a block; blocks of a source at least, so that small ones have shorter blocks; slots in a shard.
BLOCK, BLOCKS, SHARD = 128, 64, 1024
#: Documents that are placed by one window, about; slots that come from one row; rounds of a permutation.
CHUNK, RUN, ROUNDS = 1024, 1 << 14, 12
#: The weights repeat over the sources; the mix has SHARE times all words; a source is repeated at most MOST times.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def targets(sources: DataFrame, total: float, most: float = MOST) -> DataFrame:
    """sources (.., size, weight) with target: words by weight, but at most ``most`` times the size, the rest by weight over the others.

    Each round takes one row of sums to the driver; a source that is above its limit stays so, as what is left grows for the others.
    """
    cap = most * F.col("size").cast("double")
    rest, by, closed = float(total), None, -1
    while True:
        above = F.lit(False) if by is None else (F.col("weight") * rest / by > cap) if by else F.lit(True)
        r = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("used"), F.sum(F.when(~above, F.col("weight"))).alias("by")).first()
        if r["n"] == closed:
            return sources.withColumn("target", F.when(above, cap).otherwise(F.lit(rest) * F.col("weight") / by if by else cap).cast("double"))
        rest, by, closed = total - (r["used"] or 0.0), float(r["by"] or 0), r["n"]


def permuted(x: Column, n: Column, *salt: Column) -> Column:
    """x, which is in 0 .. n - 1, mapped by a pseudorandom permutation of that range.

    Swap or not: each round pairs x with k - x and swaps on a bit that depends on the pair.
    """

    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, F.lit("k"), *salt), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), r, *salt).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), x, swapped)


class Mix:
    """A mix of docs (doc_id, text, source): frames of its sources' figures, of slots and of pieces.

    size: words of a text, 0 for null.  Sources go by code point, null last.  ``sized`` has equal rows once,
    with their number (copies); over CHUNK of them are several rows.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 1):
        self.seed = seed
        size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
        sized = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("h")).groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("n"))
        sized = sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
        self.sized = written(sized.withColumn("copies", F.least(F.lit(CHUNK), F.col("n") - F.col("part") * CHUNK)).drop("n"), "mix-sizes")
        by_name = F.col("source").asc_nulls_last()
        found = self.sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows"))
        found = found.repartitionByRange(by_name).sortWithinPartitions(by_name).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        found = written(found, "mix-names")
        found = self._numbered(found, F.lit(1).cast("long"), "sid")
        every = F.array(*(F.lit(float(w)) for w in weights))
        found = found.withColumn("weight", F.get(every, F.pmod("sid", F.lit(len(weights))).cast("int")))
        sums = found.agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).first()
        self.rows = sums["rows"] or 0
        found = targets(found, share * (sums["size"] or 0))
        length = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("size") / BLOCKS)))
        found = found.withColumn("length", length).withColumn("blocks", F.ceil(F.col("size") / F.col("length")))
        passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
        found = found.withColumn("passes", passes).withColumn("slots", (F.col("passes") * F.col("blocks") + F.round((F.col("target") - F.col("passes") * F.col("size")) / F.col("length"))).cast("long"))
        found = self._numbered(found, F.col("slots"), "first")
        self.sources = written(found.select("source", "sid", F.col("size").alias("source_size"), "target", "length", "blocks", "slots", "first"), "mix-sources")
        self.total = self.sources.agg(F.sum("slots")).first()[0] or 0

    @staticmethod
    def _numbered(found: DataFrame, n: Column, name: str) -> DataFrame:
        """found with the sum of n over the sources before: over the ranges before, then in a source's own range."""
        ranges = found.groupBy("range").agg(F.sum(n).alias("_sum")).select("range", (F.sum("_sum").over(W.orderBy("range")) - F.col("_sum")).alias("_before"))
        inside = F.sum(n).over(W.partitionBy("range").orderBy("at").rowsBetween(W.unboundedPreceding, 0)) - n
        return found.withColumn("_inside", inside).join(ranges, "range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")

    def with_source(self, df: DataFrame) -> DataFrame:
        """df with the figures of its source."""
        own = self.sources.withColumnRenamed("source", "_source")
        return df.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def drawn(self) -> DataFrame:
        """(shard, sid, n): how many slots of each shard a source has, where it has any."""
        long = lambda x: F.lit(x).cast("long")
        # these rows are few bytes, what comes from them is not: so many tasks as that asks for
        tasks = max(1, min(-(-self.total // RUN), int(self.sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-self.total // (RUN << 8)))
        runs = self.sources.where("slots > 0").withColumn("run", F.explode(F.sequence(long(0), F.floor((F.col("slots") - 1) / RUN)))).repartition(tasks, "sid", "run")
        df = runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, F.least("slots", (F.col("run") + 1) * RUN) - 1)))
        place = permuted(F.col("first") + F.col("k"), long(max(1, self.total)), F.lit(self.seed))
        return df.select(F.floor(place / SHARD).alias("shard"), "sid").groupBy("shard", "sid").agg(F.count("*").alias("n"))

    def slots(self) -> DataFrame:
        """(shard, slot, sid, block): what the mix has at each place, by the counts that are drawn for each shard."""
        df = self.drawn().withColumn("chunk", F.floor(F.col("shard") / CHUNK))
        # a source's slots in the shards before: in chunks before, then in its own; no window has a whole source
        sums = df.groupBy("sid", "chunk").agg(F.sum("n").alias("sum"))
        sums = sums.select("sid", "chunk", (F.sum("sum").over(W.partitionBy("sid").orderBy("chunk")) - F.col("sum")).alias("before"))
        inside = F.sum("n").over(W.partitionBy("sid", "chunk").orderBy("shard")) - F.col("n")
        df = df.withColumn("inside", inside).join(sums, ["sid", "chunk"]).withColumn("k", F.col("before") + F.col("inside"))
        by = W.partitionBy("shard")
        df = df.withColumns({"at": F.sum("n").over(by.orderBy("sid")) - F.col("n"), "filled": F.sum("n").over(by)})
        df = df.select("shard", "sid", "k", "at", "filled", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")).join(self.sources.select("sid", "blocks"), "sid")
        k = F.col("k") + F.col("j")
        block = permuted(F.pmod(k, "blocks"), F.col("blocks"), F.col("sid"), F.floor(k / F.col("blocks")), F.lit(self.seed))
        slot = permuted(F.col("at") + F.col("j"), F.col("filled"), F.lit("slot"), F.col("shard"), F.lit(self.seed))
        return df.select("shard", slot.alias("slot"), "sid", block.alias("block"))

    def placed(self) -> DataFrame:
        """Each document, equal ones one by one, with ``start``, its first word's place among its source's words.

        Sums over chunks of about CHUNK documents, then within each: no window has a whole source.
        """
        chunk = F.pmod(F.xxhash64("doc_id", "h", "part"), F.lit(max(1, self.rows // CHUNK)))
        docs = self.with_source(self.sized).withColumn("chunk", chunk)
        words = F.col("size") * F.col("copies")
        sums = docs.groupBy("sid", "chunk").agg(F.sum(words).alias("n"))
        sums = sums.select("sid", "chunk", (F.sum("n").over(W.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))
        inside = F.sum(words).over(W.partitionBy("sid", "chunk").orderBy("doc_id", "h", "part").rowsBetween(W.unboundedPreceding, 0)) - words
        docs = docs.withColumn("inside", inside).join(sums, ["sid", "chunk"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        return docs.withColumn("start", F.col("before") + F.col("inside") + F.col("copy") * F.col("size")).drop("before", "inside", "chunk", "part", "copies", "copy")

    def pieces(self) -> DataFrame:
        """Each document's part in each block: (.., block, offset, words, places); places: where the mix has the block, in order, empty for nowhere."""
        end, length = F.col("start") + F.col("size"), F.col("length")
        docs = self.placed().where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))))
        offset = F.greatest("start", F.col("block") * length) - F.col("start")
        docs = docs.withColumn("offset", offset).withColumn("words", F.least(end, (F.col("block") + 1) * length) - F.col("start") - F.col("offset"))
        # MOST places at most; by its few sources Spark would take this for a small table and broadcast it
        places = self.slots().groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.col("shard") * SHARD + F.col("slot"))).alias("places")).hint("merge")
        return docs.join(places, ["sid", "block"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<bigint>")))


def mix_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards, first_place) for each row of docs (doc_id, text, source).

    taken: the words of the row that the mix has, repeats counted; at most MOST times size.  shards: how many output
    shards have some of them; first_place: the first place, shard * SHARD + slot, null for none.  Rows
    without doc_id or source take part; equal rows have places of their own; empty texts have size and taken 0; texts count
    whole, however long; other columns are left out; an empty table gives an empty table.
    """
    mix = Mix(docs)
    keys = ["doc_id", "h", "size", "source", "source_size", "target", "sid", "start"]
    none = {"taken": F.lit(0).cast("long"), "shards": F.lit(0).cast("long"), "first_place": F.lit(None).cast("long")}
    empty = mix.placed().where("size = 0").withColumns(none)
    full = mix.pieces().groupBy(keys).agg(F.sum(F.col("words") * F.size("places")).alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("places", lambda p: F.floor(p / SHARD)))))).cast("long").alias("shards"), F.min(F.array_min("places")).alias("first_place"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "shards", "first_place"]
    return full.select(out).unionByName(empty.select(out))


def mixed(docs: DataFrame, with_place: bool = False) -> DataFrame:
    """The mix as documents: the columns of docs, a row for each time that the mix takes some of a document.

    A document taken whole keeps its text; otherwise the words taken stand in order, a space between them, and n_chars, if
    there is such a column, is counted anew.  Documents that are not taken at all go.  Rows that agree in doc_id, source and
    text are copies of one document; texts count whole; other columns are the document's, whatever their names.  With
    ``with_place`` the rows have (mix_shard, mix_slot), where the mix first has what they hold, in place of such columns.
    """
    mix = Mix(docs)
    taken = mix.pieces().where(F.size("places") > 0).groupBy("doc_id", "h", "source", "start", "size").agg(F.array_sort(F.collect_list(F.struct("offset", "words", "places"))).alias("pieces"))
    taken = taken.withColumn("turn", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("pieces", lambda p: F.size(p["places"]))))))
    taken = taken.withColumn("pieces", F.filter("pieces", lambda p: F.size(p["places"]) >= F.col("turn")))
    whole = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("size")
    place = F.array_min(F.transform("pieces", lambda p: F.element_at(p["places"], F.col("turn"))))
    taken = taken.select("doc_id", "h", "source", "pieces", whole.alias("whole"), place.alias("place"))
    # the columns of docs stay in a struct, so that none of them meets one of these
    once = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.xxhash64("text").alias("hash"), F.struct(*(F.col(c) for c in docs.columns)).alias("row")).dropDuplicates(["id", "of", "hash"])
    out = once.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")) & F.col("source").eqNullSafe(F.col("of")))
    words = F.when(~F.col("whole"), F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)))
    out = out.select("row", "whole", "pieces", "place", words.alias("words"))
    some = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(F.col("words"), (p["offset"] + 1).cast("int"), p["words"].cast("int")))), " ")
    out = out.select("row", "place", F.when(F.col("whole"), F.col("row.text")).otherwise(some).alias("text"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    if with_place:
        columns |= {"mix_shard": F.floor(F.col("place") / SHARD), "mix_slot": F.pmod("place", F.lit(SHARD))}
    return out.select(*(v.alias(c) for c, v in columns.items()))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix with the contract's weights takes."""
    return mix_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))

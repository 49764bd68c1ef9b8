"""Toxicity by compression distance.

Two dictionaries come from zstandard's own trainer.  The ordinary one is trained on windows of ordinary
texts.  Toxic text is mostly ordinary text as well, and a dictionary that is trained on whole toxic texts
differs from the ordinary one by chance more than by what is toxic.  So the samples of the toxic one are
picked from toxic texts: its words that are in significantly more toxic than ordinary texts, once for each
such text.  A window's distance is what it takes given the ordinary dictionary, less what it takes given
both: what the toxic dictionary tells about it that the ordinary one doesn't.  Distances of a text's windows are calibrated to a
score by a logistic fit on the labelled texts, each compressed with a dictionary made of the others.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_texts, mix64, shingles, small_batches, table, utf8, word_hashes, written

#: Words a window has.
WINDOW = 10
#: Bytes of the ordinary and of the toxic dictionary; samples each is trained on at most, picked by their hashes; bytes of the toxic one's segments and of the pieces that these are rated by.
ORDINARY, TOXIC, SAMPLES, SEGMENT, PIECE = 32768, 8192, 60_000, 16, 8
#: A word is in at least so many toxic texts, and in more than of ordinary texts by so many standard errors.
LEAST, SURE = 2, 4.5
THRESHOLD = 0.3
_FEATURES = 4


@dataclass
class Model:
    """The two dictionaries and the calibration; some 40 kB whatever the size of the corpus."""

    toxic: bytes
    ordinary: bytes
    weights: list[float]
    bias: float

    def compressors(self) -> tuple:
        """With both dictionaries, and with the ordinary one.  Matches of five bytes at least: shorter ones are chance."""
        p = zs.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=5, strategy=zs.STRATEGY_LAZY2, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for content in (self.toxic + self.ordinary, self.ordinary):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zs.ZstdCompressor(dict_data=d, compression_params=p).compress)
        return tuple(out)


def trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary from zstandard's trainer, of half the samples' bytes at most; few samples are given to it repeatedly, each time in another order."""
    if not samples:
        return b""
    total, deal = sum(map(len, samples)), random.Random(1)
    given = [s for _ in range(max(1, -(-4096 // total), -(-16 // len(samples)))) for s in deal.sample(samples, len(samples))]
    return zs.train_dictionary(max(256, min(size, total // 2)), given, **how).as_bytes()


def windows(text: bytes) -> list[bytes]:
    """The whole text, lower-cased, in windows of WINDOW words."""
    words = text.decode().lower().encode().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def features(text: bytes, toxic, ordinary) -> list[float]:
    """Of the windows' distances: mean, largest, shares of windows with 3 and 5 bytes; all 0 for an empty text."""
    saved = np.array([max(0, len(ordinary(w)) - len(toxic(w))) for w in windows(text)] or [0], float)
    return [float(saved.mean()), float(np.log1p(saved.max())), float((saved >= 3).mean()), float((saved >= 5).mean())]


def _groups(hashes: np.ndarray, at: np.ndarray) -> list[int]:
    """For each text its least hash of three words, mostly the same for near copies; 0 for a text without words."""
    return [int(s[0].astype(np.int64)) if len(s := shingles(hashes[a:b], 3)) else 0 for a, b in zip(at[:-1], at[1:], strict=True)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, group, toxic) of each word of each labelled text."""
    for batch in batches:
        data, ends = utf8(batch.column("text"))
        out: list[tuple] = []
        for i, (label, group) in enumerate(zip(batch.column("toxic").to_pylist(), _groups(*word_hashes(data, ends)), strict=True)):
            words = bytes(data[int(ends[i]) : int(ends[i + 1])]).decode().lower().encode().split()
            out += [(w, group, label) for w in {w.strip(b".,;:!?*$%&\"'()") for w in words} - {b""}]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int32()), strict=True)], names=["word", "group", "toxic"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of texts, with a number that depends on nothing but the window."""
    for batch in batches:
        data, ends = utf8(batch.column("text"))
        found = [w for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) for w in windows(bytes(data[a:b]))]
        hashes, at = word_hashes(b"".join(found), np.cumsum([0, *map(len, found)]))
        order = [int(mix64(hashes[a:b].sum(keepdims=True))[0] >> np.uint64(1)) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(found, pa.binary())], names=["n", "window"])


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Labelled texts to learn from: about ``most`` of each label at most (all if there are fewer), none held out.

    Which rows are taken depends on their ids only.  A document with several labels counts as toxic if any is 1.
    ``weight``: how many labelled texts a row stands for, the inverse of the share of its label that is taken.
    As 5 * ``most`` bounds the labels taken, they are broadcast, and no text is shuffled.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    of = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for label, n in of.items():
        share = F.when(F.col("toxic") == label, math.ceil(min(1.0, most * (4 if label == 0 else 1) / n) * (1 << 40)) / (1 << 40)).otherwise(share)
    labels = labels.withColumn("share", share).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(labels), "doc_id").select("text", "toxic", (1 / F.col("share")).alias("weight"))


def train(docs: DataFrame, labels: DataFrame, most: int = 1500) -> Model | None:
    """Learn from about ``most`` toxic and 4 * ``most`` ordinary texts; None unless there are both.

    Whole texts of that bounded sample count; what reaches the driver is bounded by most and SAMPLES.
    Where no word is that much more frequent in toxic texts, windows of toxic texts are the samples.
    """
    rows = written(sample(docs, labels, most), "toxicity-sample")
    of = Counter({r["toxic"]: r["count"] for r in rows.distinct().groupBy("toxic").count().collect()})
    n, m = of[1], of[0]
    if not n or not m:
        return None
    counted = written(map_texts(rows, _counted, "word binary, `group` long, toxic int").distinct(), "toxicity-words")
    counts = counted.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    p = (F.col("a") + F.col("b")) / (n + m)
    lift = (F.col("a") / n - F.col("b") / m) / F.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    sure = counts.where((F.col("a") >= LEAST) & (lift >= SURE)).select("word")
    found = counted.where("toxic = 1").join(sure, "word").orderBy(F.xxhash64("word", "group"), "word", "group").limit(SAMPLES).select("word", "group").collect()
    samples = [(b" " + bytes(r["word"]) + b" ", r["group"] & 1) for r in found]

    def windows_of(label: int) -> list[bytes]:
        found = map_texts(rows.where(F.col("toxic") == label), _sampled, "n long, window binary").orderBy("n", "window").limit(SAMPLES)
        return [bytes(r["window"]) for r in found.collect()]

    samples = samples or [(w, i & 1) for i, w in enumerate(windows_of(1))]
    ordinary = trained(windows_of(0), ORDINARY) or b" "
    made = lambda half: trained([s for s, k in samples if k in half], TOXIC, k=SEGMENT, d=PIECE)
    model = Model(made((0, 1)), ordinary, [0.0] * _FEATURES, 0.0)
    # each text meets the dictionary made without its half
    others = [Model(made((1 - k,)) or model.toxic, ordinary, [], 0.0) for k in (0, 1)]
    scored = _featured(rows, others).collect()
    x = np.array([r["f"] for r in scored])
    y = np.array([r["toxic"] for r in scored], float)
    model.weights, model.bias = _logistic(x, y, np.array([r["weight"] for r in scored]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[list[float], float]:
    """Newton's method on rows that count by their weight, with a small cost for large weights."""
    share = weight / weight.sum()
    scale = np.sqrt(share @ (x - share @ x) ** 2) + 1e-9
    x = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    cost = np.diag([ridge / 100] * (x.shape[1] - 1) + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + cost + 1e-9 * np.eye(len(w)), x.T @ (share * (p - y)) + cost @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (w[:-1] / scale).tolist(), float(w[-1])


def _featured(rows: DataFrame, models: list[Model]) -> DataFrame:
    """toxic, weight and features of rows, by the model with the number of the row's half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [m.compressors() for m in models]
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            f = [features(bytes(data[a:b]), *compressors[g & 1]) for a, b, g in zip(ends[:-1].tolist(), ends[1:].tolist(), _groups(*word_hashes(data, ends)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), pa.array(f, pa.list_(pa.float64()))], names=["toxic", "weight", "f"])

    return map_texts(rows, run, "toxic int, weight double, f array<double>")


def with_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on), by whole texts.

    A null or empty text has no window that saves anything: the score of clean text.  Without a model
    (no labels of one kind) every score is 0.  Columns named score and predicted are replaced; equal
    texts have equal scores; an empty table gives an empty table.
    """
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary = model.compressors()
        for batch in batches:
            data, ends = utf8(batch.column(batch.schema.get_field_index("text")))
            out = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                z = model.bias + sum(w * x for w, x in zip(model.weights, features(bytes(data[a:b]), toxic, ordinary), strict=True))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    return map_texts(docs, run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels of those that are not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

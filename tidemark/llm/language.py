"""Language identification with error-correcting output codes.

Each language has a codeword of bits.  One binary classifier for each bit reads hashed character
n-grams and predicts that bit; decoding takes the language whose codeword costs least, each bit's
loss weighing as much as its classifier is to be trusted.  Two codewords at nearly the same cost make
a prediction ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_texts, small_batches, spans, table, utf8

#: Hashed n-grams; lengths of n-grams; bits of a codeword at most.
SIZE, GRAMS, BITS = 2048, (1, 2, 3), 31
#: A text is ambiguous if the second-best language has over this share of the trust in the best.
CLOSE = 0.8
UNKNOWN = "und"
TOGETHER = 1 << 20
_MUL = np.uint32(0x9E3779B1)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 0."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def grams(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the root of each hashed n-gram's share, of unit length; and its number of letters.

    What is no letter counts as one space; runs of it count once.
    """
    n = len(ends) - 1
    out, has = np.zeros((n, SIZE), np.float32), np.zeros(n, np.int64)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    if not len(points):
        return out, has
    at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    owner = np.searchsorted(ends, at, "right") - 1
    c = letters()[points]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (owner[1:] != owner[:-1])
    c, owner = c[keep], owner[keep]
    has[:] = np.bincount(owner[c != 0], minlength=n)
    h = np.zeros(len(c), np.uint32)
    for k in range(max(GRAMS)):
        size = len(c) - k
        if size <= 0:
            break
        h = (h[:size] ^ c[k:]) * _MUL
        h ^= h >> np.uint32(15)
        if k + 1 in GRAMS:
            same = owner[:size] == owner[k:]
            key = owner[:size][same] * SIZE + (h[same] >> np.uint32(3)) % SIZE
            out += np.bincount(key, minlength=n * SIZE).reshape(n, SIZE)
    total = out.sum(1, keepdims=True)
    np.sqrt(out / np.maximum(total, 1), out=out)
    return out, has


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all different splits of the languages for few languages, else random splits, far apart."""
    if k <= 2:
        return np.array([[1], [-1]])[:k]
    if k <= 5:
        splits = np.arange(1, 2 ** (k - 1))
        return np.where((splits[None, :] >> np.arange(k)[:, None]) & 1, 1, -1)
    best, apart = None, -1
    rng = np.random.default_rng(7)
    for _ in range(200):
        m = rng.choice([-1, 1], (k, max(BITS, 2 * k)))
        far = min(int((a != b).sum()) for i, a in enumerate(m) for b in m[:i])
        if far > apart and (abs(m.sum(0)) < k).all():
            best, apart = m, far
    return best


@dataclass
class Model:
    """Languages, their codewords, a linear classifier for each bit, and how much each bit is to be trusted for each language."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of the best language, its score (0 to 1), and whether another is close."""
        margin = x @ self.weights + self.bias
        cost = np.einsum("lb,nlb->nl", self.trust, np.log1p(np.exp(-np.clip(self.codes[None] * margin[:, None], -30, 30))))
        p = np.exp(cost.min(1, keepdims=True) - cost)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, score, second > CLOSE * score


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], ridge: float = 1e-3, rounds: int = 200) -> Model:
    """One logistic classifier a bit, all by the same accelerated descent, rows weighing so that languages count the same.

    Trust is the share of rows of a language whose bit comes out right, over three folds that leave them out.
    """
    codes = codewords(len(langs))

    def learn(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = codes[y].astype(np.float32)
        weigh = (1 / np.bincount(y, minlength=len(langs)).clip(1))[y][:, None] / len(set(y.tolist()))
        w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
        v, c = w, b
        for i in range(rounds):
            g = -(t / (1 + np.exp(np.clip(t * (x @ v + c), -30, 30)))) * weigh
            w2, c2 = v - 8.0 * (x.T @ g + ridge * v), c - 8.0 * g.sum(0)
            v, c = w2 + (i / (i + 3)) * (w2 - w), c2 + (i / (i + 3)) * (c2 - b)
            w, b = w2, c2
        return w, b

    right, seen = np.ones(codes.shape), np.full(codes.shape, 1.0)
    fold = np.arange(len(y)) % 3
    for k in range(3):
        on, off = fold != k, fold == k
        if on.any() and off.any():
            w, b = learn(x[on], y[on])
            ok = np.sign(x[off] @ w + b) == codes[y[off]]
            np.add.at(right, y[off], ok)
            np.add.at(seen, y[off], 1)
    trust = right / seen
    w, b = learn(x, y)
    return Model(langs, codes, w, b, trust / trust.sum(1, keepdims=True) * codes.shape[1])


def train(docs: DataFrame, most: int = 400) -> Model | None:
    """Learn from text and lang of rows that are not held out: about ``most`` whole texts of each language.

    Which rows are taken depends on ids only, on texts where there is none.  Their n-gram counts, not their texts, come to the driver:
    8 kB each.  None if no row has both a language and letters.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    of = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not of:
        return None
    share = F.lit(0.0)
    for lang, n in of.items():
        share = F.when(F.col("lang") == lang, min(1.0, most / n)).otherwise(share)
    pick = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    rows = rows.where(F.pmod(pick, F.lit(1 << 40)) < share * (1 << 40))  # fine enough for some 10**14 rows of a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            for a, b in spans(ends, TOGETHER):
                x, has = grams(bytes(data[int(ends[a]) : int(ends[b])]), ends[a : b + 1] - ends[a])
                keep = np.flatnonzero(has)
                f = pa.array([x[i].tobytes() for i in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(keep)), batch.column("lang").slice(a, b - a).take(pa.array(keep)), f], names=["doc_id", "lang", "f"])

    found = sorted(map_texts(rows, run, "doc_id long, lang string, f binary").collect(), key=lambda r: (r["doc_id"] or 0, r["lang"], bytes(r["f"])))
    if not found:
        return None
    langs = sorted({r["lang"] for r in found})
    x = np.frombuffer(b"".join(bytes(r["f"]) for r in found), np.float32).reshape(len(found), SIZE)
    return fit(x, np.array([langs.index(r["lang"]) for r in found]), langs)


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, by whole texts.

    A text that is null or has no letter is ``und`` with score 0 and not ambiguous, as is every text
    without a model.  Columns of these names are replaced; equal texts have equal results; an empty
    table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(False)})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double, ambiguous boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            data, ends = utf8(batch.column(batch.schema.get_field_index("text")))
            pred, score, close = [], [], []
            for a, b in spans(ends, TOGETHER):
                x, has = grams(bytes(data[int(ends[a]) : int(ends[b])]), ends[a : b + 1] - ends[a])
                best, p, near = model.predict(x)
                none = has == 0
                best[none], p[none], near[none] = len(model.langs), 0, False
                pred.append(names[best])
                score.append(p)
                close.append(near)
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, join(pred, pa.string()), join(score, pa.float64()), join(close, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return map_texts(docs, run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = with_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")

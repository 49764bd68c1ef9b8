"""URL filters: rules, and for urls that no rule fits a logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ALLOW, BLOCK = "allow", "block"
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))
#: Lengths of n-grams; weights of hashed n-grams; labelled urls used at most.
GRAMS, SIZE, LABELLED = (3, 4, 5), 1 << 14, 20_000
#: Share of urls that are to be blocked among those that no rule fits.
PRIOR = 0.25
#: Words by which a person would block or allow a host, and words that say nothing about it.
BLOCKED = "casino poker jackpot slots betting bets roulette lottery pills viagra pharmacy steroids adult xxx porn escorts spam linkfarm ads adserver tracking tracker popups malware".split()
ALLOWED = "news garden library weather school history museum travel cooking science music sports nature health city university forum wiki docs photos books theatre rivers maps".split()
NEUTRAL = "online best my the top daily free world".split()


def seed() -> list[tuple[str, str]]:
    """A small table of labelled urls: each word with four neutral ones, before or after, with and without a page."""
    out = []
    for verdict, words in ((BLOCK, BLOCKED), (ALLOW, ALLOWED)):
        for i, word in enumerate(words):
            for j in range(4):
                other = NEUTRAL[(i + 2 * j) % len(NEUTRAL)]
                host = (f"{word}-{other}", f"{other}-{word}", f"{other}{word}", f"{word}{other}")[j]
                site = f"{('', 'www.', 'm.', 'blog.')[(i + j) % 4]}{host}.example.{('com', 'net', 'org')[(i + j) % 3]}"
                out += [(f"https://{site}/{page}", verdict) for page in ("", ("en", "de", "fr", "es")[(i // 3 + j) % 4] + f"/{7 * i + j}{('', '.html', '?page=2')[i % 3]}")]
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end; empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host (or a domain above it) and the path's beginning, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts' n-grams: the text that each is in, and its hash below SIZE."""
    ends = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    h, owners, out = np.zeros(len(raw), np.uint32), [], []
    for k in range(max(GRAMS)):
        n = max(0, len(raw) - k)
        h = (h[:n] ^ (raw[k:] + np.uint32(1))) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        if k + 1 in GRAMS:
            same = owner[:n] == owner[k:]
            owners.append(owner[:n][same])
            out.append(((h[same] * np.uint32(0x9E3779B1)) >> np.uint32(18)) % SIZE)
    return np.concatenate(owners), np.concatenate(out)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, n-gram and value of each n-gram; a text's values have length 1 together."""
    owner, gram = hashed(texts)
    n = np.bincount(owner, minlength=len(texts))
    return owner, gram, 1 / np.sqrt(np.maximum(n, 1))[owner]


def _joined(host: str, path: str) -> bytes:
    return f"^{host}$/{path}".encode()


def train(labelled: DataFrame, rounds: int = 1500, rate: float = 16.0, ridge: float = 1e-6, prior: float = PRIOR) -> tuple[np.ndarray, float]:
    """Weights of hashed n-grams and a bias, from a small table (url, verdict), of which LABELLED rows count at most.

    ``prior`` is the share of urls to be blocked where they are judged, whatever it is in the table.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select(host.alias("h"), path.alias("p"), "verdict").orderBy(F.xxhash64("url"), "url", "verdict").limit(LABELLED).collect()
    y = np.array([r["verdict"] == BLOCK for r in rows], float)
    owner, gram, value = _features([_joined(r["h"], r["p"]) for r in rows])
    w, b = np.zeros(SIZE), 0.0
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[gram] * value, len(rows)) + b, -30, 30)))
        g = (p - y) / len(rows)
        w -= rate * (np.bincount(gram, g[owner] * value, SIZE) + ridge * w)
        b -= rate * g.sum()
    share = np.clip(y.mean() if len(rows) else prior, 1e-3, 1 - 1e-3)
    return w.astype(np.float32), float(b + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the classifier's, 0 to 1, higher: block).

    A rule's verdict goes before the classifier's, which blocks from 0.5 on.  A null url, or one without
    ``://``, has empty host and path and goes to the classifier.  Columns of these names are replaced;
    equal urls have equal results; without labelled urls the classifier allows everything; an empty table
    gives an empty table.  The weights have a fixed size, 64 kB.
    """
    weights, bias = train(labelled)
    if not weights.any():
        bias = -1.0
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host, "path": path})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = [_joined(*x) for x in zip(batch.column(at("host")).to_pylist(), batch.column(at("path")).to_pylist(), strict=True)]
            owner, gram, value = _features(texts)
            z = np.bincount(owner, weights[gram] * value, len(texts)) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[*batch.schema.names, "score"])

    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    pages = pages.mapInArrow(run, schema).withColumns({"rule": rule, "_ruled": verdict})
    return pages.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))).drop("_ruled")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    labelled = spark.createDataFrame(seed(), "url string, verdict string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), labelled).select("page_id", "host", "path", "rule", "verdict", "score")

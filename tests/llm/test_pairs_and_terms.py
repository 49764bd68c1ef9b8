"""Hard negatives, SimHash groups and source divergence on small tables, each against a plain computation."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tidemark.llm import divergence, hard_negatives, simhash

# ---- hard negatives


def _plain_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95):
    rows = [r for r in rows if None not in r]
    first = {}
    for a in (r for r in anchors if None not in r):
        first[a[0]] = min(first.get(a[0], a), a, key=lambda r: (r[1], r[2]))
    out = []
    for i, label, v in first.values():
        scored = [(sum(int(a) * int(b) for a, b in zip(v, w)), j, other) for j, other, w in rows]
        best = sorted((-s, j) for s, j, other in scored if other == label and j != i)[:positives]
        for s, j in best:
            inside = sorted((-n, k) for n, k, other in scored if other != label and low * -s <= 100 * n <= high * -s)[:negatives]
            out += [(i, j, rank, k, -s, -n) for rank, (n, k) in enumerate(inside, 1)]
    return sorted(out)


def _negatives(spark, rows, anchors, **more):
    frames = [spark.createDataFrame(x, "id long, label int, v array<double>") for x in (rows, anchors)]
    got = hard_negatives.hard_negatives(*frames, **more)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_of_random_vectors(spark, seed, monkeypatch):
    rng = random.Random(seed)
    if seed:
        monkeypatch.setattr(hard_negatives, "SHARD", 60)
    rows = []
    for i in range(300):
        base = [10.0 * (j % 5 == i % 5) + 3 * (j % 3 == i % 3) for j in range(20)]
        width = rng.choice([20, 20, 20, 7, 0])
        rows.append((i, i % 4 if rng.random() < 0.95 else None, [float(round(x * rng.choice([1, 2]) + rng.randrange(-6, 7))) for x in base][:width]))
    rows += [(7, 2, [5.0] * 20), (7, 2, [5.0] * 20), (None, 1, [9.0] * 20), (400, 0, None)] + [(500 + i, 3, [4.0] * 20) for i in range(9)]  # repeated ids, ties
    anchors = [r for r in rows if r[0] is not None and r[0] % 6 in (0, 1)]
    want = _plain_negatives(rows, anchors)
    assert _negatives(spark, rows, anchors) == want and len(want) > 100


def test_hard_negatives_of_very_long_and_of_no_vectors(spark):
    rows = [(1, 0, [3e9, 1.0]), (2, 0, [1e9, 5.0]), (3, 0, [2.0, 2.0]), (4, 1, [9e8, -3.0]), (5, 1, [1e9, 0.0]), (6, 1, [1.0, 1.0]), (7, 0, [-1.0, 0.0]), (8, 1, [0.0, 0.0])]
    assert _negatives(spark, rows, rows[:3]) == _plain_negatives(rows, rows[:3]) != []
    assert _negatives(spark, rows, []) == _negatives(spark, [], rows) == []
    assert _negatives(spark, rows[:3], rows[:3]) == []  # one label only
    with pytest.raises(Exception, match="64 bits"):
        _negatives(spark, [(1, 0, [1e30]), (2, 0, [1e30]), (3, 1, [8e29])], [(1, 0, [1e30])])


def test_hard_negatives_leave_other_columns_out(spark):
    df = spark.createDataFrame([(1, 0, [9.0]), (2, 0, [8.0]), (3, 1, [6.0])], "id long, label int, v array<double>").withColumns({"shard": F.lit("x"), "asks": F.lit(None).cast("int"), "place": F.lit(1.5), "positives": F.lit("p")})
    assert [tuple(r) for r in hard_negatives.hard_negatives(df, df.where("id = 1")).collect()] == [(1, 2, 1, 3, 72, 54)]


def test_a_search_reads_no_more_than_its_threshold_asks_for():
    """Postings are read as far as suffix norms reach the threshold, and what they leave out is never wanted."""
    rng = np.random.default_rng(0)
    rows = np.round(rng.normal(0, 40, (800, 32)) * rng.lognormal(0, 1, (800, 1)))
    shard = hard_negatives.Shard(np.arange(800), np.zeros(800, np.int64), rows)
    query = rows[np.argmax((rows**2).sum(1))]
    search = hard_negatives.Search(shard, query)
    every, scores, before = np.ones(800, bool), rows @ query, 0
    for part in (0.9, 0.5, 0.2, 0.05, -1.0):
        threshold = part * float(scores.max())
        found = search.above(threshold, every)
        assert set(np.flatnonzero(scores >= threshold)) <= set(found.tolist())
        assert (search.scores(found) == scores[found]).all()
        assert sum(search.read) >= before
        before = sum(search.read)
        if part == 0.5:
            assert before < 0.5 * 800 * len(shard.order)
    assert before == 800 * len(shard.order)


# ---- SimHash


def _plain_fingerprint(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain_groups(rows):
    prints = [(i, _plain_fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in prints if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if None not in (a, b) and (x ^ y).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(((i, f"{x:016x}", None if i is None else root(i)) for i, x in prints), key=str)


def _groups(df):
    return sorted((tuple(r) for r in simhash.simhash_groups(df).collect()), key=str)


def test_simhash_of_odd_texts(spark):
    rng = random.Random(2)
    prose = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(400)]
    rows = [(9, None), (8, ""), (7, " \t\x0b\n"), (6, "Word"), (5, "two  WORDS"), (4, "É x y Z"), (3, " ".join(prose)), (2, " ".join(prose).upper()), (30, " ".join(prose[:-1])), (31, " ".join(prose[:200] + ["new"] + prose[200:])), (None, "Word"), (None, None)]
    rows += [(40, "one text of document forty"), (40, "Word"), (41, "one text of document forty"), (41, "one text of document forty"), (50, "a b c " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("mine"), "rep": F.lit(1), "salt": F.lit(None).cast("string"), "shard": F.lit(2.5)})
    got = _groups(df)
    assert got == _plain_groups(rows)
    assert {r[0]: r[2] for r in got}[41] == 6  # by the two texts of 40
    assert _groups(df.repartition(7)) == got and _groups(df.limit(0)) == []


def test_simhash_groups_of_random_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 30, 300]))] for _ in range(40)]
    rows = []
    for i in range(260):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 7 % 260, " ".join(text)))
    got = _groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == _plain_groups(rows) and 10 < len({r[2] for r in got}) < 250


@pytest.mark.parametrize("seed", range(3))
def test_shards_of_a_tree_find_every_near_pair(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(simhash, "LEAF", 100)
    monkeypatch.setattr(simhash, "ROOT", 1)
    monkeypatch.setattr(simhash, "DIRECT", 1 << 10)
    fp = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = fp[:700].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64)
    tight = fp[-1] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    fp = np.unique(np.concatenate([fp, near, tight]))
    top = simhash.Top(rng.permutation(fp)[:1000], len(fp))
    assert top.shards > 20
    sides: dict[int, dict[int, np.ndarray]] = {}
    for shard, side, at in top.dealt(fp):
        sides.setdefault(shard, {})[side] = at
    whole = np.arange(len(fp))
    for parts in sides.values():
        x, y = parts.get(0, parts.get(1)), parts.get(2)
        parent = simhash.forest(fp, x, None if 0 in parts else y if y is not None else np.zeros(0, np.int64))
        moved = np.flatnonzero(parent != np.arange(len(fp)))
        simhash._united(whole, moved, parent[moved])
    want = np.arange(len(fp))
    for i in range(0, len(fp), 256):
        a, b = np.nonzero(np.bitwise_count(fp[i : i + 256, None] ^ fp[None, :]) <= 3)
        simhash._united(want, a + i, b)
    assert (whole == want).all() and len(np.unique(want)) < len(fp) - 1000


# ---- source divergence


def _plain_divergence(rows, least=3, most=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    texts = [(lang, source, ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in texts}:
        own = [r for r in texts if r[0] == lang]
        docs = {}
        for _, _, terms in own:
            for t in set(terms):
                docs[t] = docs.get(t, 0) + 1
        kept = sorted(t for t, n in docs.items() if n >= least)

        def likely(groups):
            n = {t: sum(terms.count(t) for terms in groups) for t in kept}
            below = sum(n.values()) + len(kept)
            return n, {t: 1 + int(Fraction(10**9 * (n[t] + 1), below)) for t in kept}

        by_source = {s: likely([t for _, x, t in own if x == s]) for s in {r[1] for r in own}}
        _, q = likely([t for _, _, t in own])
        far = lambda p, q: (p - q) * (p - q) // q
        for s, (n, p) in by_source.items():
            parts = {"pair": [(-sum(far(p[t], by_source[o][1][t]) for t in kept), o.encode(), o) for o in by_source if o != s], "term": [(-far(p[t], q[t]), t.encode(), t) for t in kept if n[t] > 0 and p[t] > q[t]]}
            for part, items in parts.items():
                for rank, (value, _, item) in enumerate(sorted(items)[: most if part == "term" else None], 1):
                    out.append((lang, s, part, item, -value, rank))
    return sorted(out)


def test_divergence_of_small_tables(spark):
    rng = random.Random(5)
    terms = ["a", "Ab", "eightlet", "ninelette", "sixteenlettersxx", "seventeenlettersx", "sëvénteen", "日本", "日本語のとても長い言葉", "x" * 5000, "ÀB", "àb"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(terms) + rng.choice([" ", "0", "_", "\x00", "@", "`", "  "]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None, "é"]), text))
    rows += [("en", "silent", None), ("en", "silent", ""), ("xx", "one", "alone here"), ("xx", "two", "not kept"), ("yy", "one", "again again"), ("en", "s1", rows[0][2])] + [rows[3]] * 3
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("mine"), "n": F.lit(1), "docs": F.lit("x"), "p": F.lit(0.5), "value": F.lit(None).cast("string"), "doc_id": F.lit(7)})
    for most in (200, 2):
        got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.divergence(df, most=most).collect())
        assert got == _plain_divergence(rows, most=most)
    assert ("xx", "one", "pair", "two", 0, 1) in got and any(r[1] == "silent" for r in got)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_terms_in_buckets_of_length(spark):
    """Counts of terms of every length, over batches, equal a plain count."""
    rng = random.Random(6)
    alphabet = "abcZ é日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(300)]
    got = {(r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(spark.createDataFrame([("l", f"s{i % 3}", t) for i, t in enumerate(texts)], "lang string, source string, text string").repartition(5)).collect() if r.term is not None}
    want = {}
    for i, t in enumerate(texts):
        terms = [w.replace("Z", "z") for w in t.split()]
        for w in terms:
            n, docs = want.get((f"s{i % 3}", w), (0, 0))
            want[f"s{i % 3}", w] = n + 1, docs
        for w in set(terms):
            n, docs = want[f"s{i % 3}", w]
            want[f"s{i % 3}", w] = n, docs + 1
    assert got == want and {1, 8, 9, 16, 17} <= {len(w.encode()) for _, w in want}

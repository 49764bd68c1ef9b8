"""Byte-level BPE encoding and decoding.

Texts of a batch lie in one buffer.  Each code point becomes a symbol of a small alphabet; a symbol is
a transition function on eight states.  Composing functions is associative, so the state before every
code point comes from a scan in blocks, without a regular expression.  States and symbols give the
slices; a cache holds the ids of slices seen before, and the others are merged together, one pair of
each slice at a time, in arrays.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, small_batches, spans, table, utf8

#: Symbols: letter; letter that can end '(s t m d); head of 're 've 'll; number; other; apostrophe; space; other white space.
LETTER, TAIL, HEAD, NUMBER, OTHER, QUOTE, SPACE, BLANK = range(8)
#: States, after a code point: in letters, in numbers, in others, after a space, after other white space,
#: after an apostrophe that begins a slice, after the head of a contraction, after a whole contraction.
IN_L, IN_N, IN_O, AFTER_SPACE, AFTER_BLANK, AFTER_QUOTE, AFTER_HEAD, AFTER_ALL = range(8)
#: White space of the pattern's \s.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 256


def _step(state: int, symbol: int) -> int:
    if symbol <= HEAD:
        if state == AFTER_QUOTE:
            return (IN_L, AFTER_ALL, AFTER_HEAD)[symbol]
        return AFTER_ALL if state == AFTER_HEAD else IN_L
    if symbol == QUOTE:
        return IN_O if state in (IN_O, AFTER_SPACE, AFTER_QUOTE) else AFTER_QUOTE
    return {NUMBER: IN_N, OTHER: IN_O, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK}[symbol]


def _begins(state: int, symbol: int) -> bool:
    """Whether a slice begins at a code point, but for white space before what is not white space."""
    if symbol <= HEAD:
        return not (state in (IN_L, AFTER_SPACE, AFTER_HEAD) or state == AFTER_QUOTE and symbol != LETTER)
    if symbol == NUMBER:
        return state not in (IN_N, AFTER_SPACE)
    if symbol in (OTHER, QUOTE):
        return state not in (IN_O, AFTER_SPACE, AFTER_QUOTE)
    return state not in (AFTER_SPACE, AFTER_BLANK)


#: By symbol, the function as eight numbers of three bits; 8 more symbols are the same at a text's start, where the state before is AFTER_ALL.
FUNCTION = np.array([sum(_step(q, s) << 3 * q for q in range(8)) for s in range(8)] + [sum(_step(AFTER_ALL, s) << 3 * q for q in range(8)) for s in range(8)], np.uint32)
BEGINS = np.array([[_begins(q, s) for q in range(8)] for s in range(8)] + [[True] * 8] * 8).ravel()
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The symbol of each code point, before its neighbours are looked at."""
    if not _kinds:
        by = {"L": LETTER, "N": NUMBER}
        out = np.array([by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        out[WHITE], out[0x20], out[0x27] = BLANK, SPACE, QUOTE
        out[[ord(c) for c in "stmd"]] = TAIL
        _kinds.append(out)
    return _kinds[0]


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol: functions of blocks, a scan over blocks, then states within blocks."""
    n = len(symbols)
    rows = -(-n // BLOCK)
    f = np.zeros(rows * BLOCK, np.uint32)
    f[:n] = FUNCTION[symbols]
    f = np.ascontiguousarray(f.reshape(rows, BLOCK).T)
    seven, three = np.uint32(7), np.uint32(3)
    whole = np.repeat(np.arange(8, dtype=np.uint32)[:, None], rows, 1)
    for j in range(BLOCK):
        whole = (f[j] >> (whole * three)) & seven
    reach = 1
    while reach < rows:  # whole[:, i] becomes the function of all blocks up to i
        whole[:, reach:] = np.take_along_axis(whole[:, reach:], whole[:, :-reach].astype(np.int64), 0)
        reach *= 2
    now = np.full(rows, AFTER_ALL, np.uint32)
    now[1:] = whole[AFTER_ALL, :-1]
    out = np.empty((BLOCK, rows), np.uint8)
    for j in range(BLOCK):
        out[j] = now
        now = (f[j] >> (now * three)) & seven
    return out.T.ravel()[:n]


def slices(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Byte offsets at which slices begin, in texts that lie one after another in data."""
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    first = np.zeros(len(points), bool)
    first[np.searchsorted(at, ends[:-1][ends[:-1] < len(data)])] = True
    symbols = kinds()[points]
    more = ~first[1:]  # the next code point is of the same text
    here, then = points[:-1], points[1:]
    head = more & (((here == ord("r")) | (here == ord("v"))) & (then == ord("e")) | (here == ord("l")) & (then == ord("l")))
    symbols[:-1][head] = HEAD
    white = symbols >= SPACE
    last = np.zeros(len(points), bool)  # white space before something else of the same text
    last[:-1] = white[:-1] & ~white[1:] & more
    symbols[first] += 8
    return at[BEGINS[symbols.astype(np.uint16) * 8 + states_before(symbols)] | last]


class Vocabulary:
    """Ranks of byte strings, and the merged rank of each pair of them that makes another."""

    _known: dict[str, Vocabulary] = {}

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.bytes = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.bytes[rank] = piece
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):  # each free place takes one of the pairs that want it, the others go one on
            free = self.keys[slot] == 0xFFFFFFFFFFFFFFFF
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.values[slot[one]] = keys[one], values[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, content: bytes) -> Vocabulary:
        key = hashlib.sha256(content).hexdigest()
        if key not in cls._known:
            cls._known[key] = cls(content)
        return cls._known[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's bytes together, NONE where they are no entry."""
        keys = (left << 32 | right).astype(np.uint64)
        slot = self._slot(keys)
        out = self.values[slot]
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != 0xFFFFFFFFFFFFFFFF))
        out[found != keys] = NONE
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (found != 0xFFFFFFFFFFFFFFFF)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as little-endian 32-bit numbers, of each piece: in each round, all merge their lowest and leftmost pair."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lens)
        out: list = [b""] * len(pieces)
        rank = np.full(len(ids), NONE, np.int64)  # of the pair that begins here
        rank[:-1] = self.merged(ids[:-1], ids[1:])
        rank[np.cumsum(lens) - 1] = NONE
        while len(ids):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(ids)))
            done = low == NONE
            if done.any():
                flat = ids.astype("<u4").tobytes()
                for p, a, n in zip(owner[start[done]].tolist(), start[done].tolist(), size[done].tolist(), strict=True):
                    out[p] = flat[4 * a : 4 * (a + n)]
                keep = np.repeat(~done, size)
                ids, owner, rank, low, size = ids[keep], owner[keep], rank[keep], low[~done], size[~done]
                if not len(ids):
                    break
                start = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(low, size))
            hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]  # the leftmost of each
            ids[hit] = low
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            back = np.zeros(len(ids), bool)
            back[hit] = True
            ids, owner, rank, back = ids[keep], owner[keep], rank[keep], np.flatnonzero(back[keep])
            for at in (back, back[back > 0] - 1):
                inside = at[at + 1 < len(ids)]
                rank[at] = NONE
                inside = inside[owner[inside] == owner[inside + 1]]
                rank[inside] = self.merged(ids[inside], ids[inside + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one long piece, with a heap of pairs."""
        ids: list = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.merged(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := self.ranks.get(self.bytes[ids[i]] + self.bytes[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x is not None], "<u4").tobytes()

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice, from the cache or by merging."""
        get = self.cache.get
        out = [get(p) for p in pieces]
        if None in out:
            if len(self.cache) > CACHED:
                self.cache.clear()
            new = dict.fromkeys(p for p, x in zip(pieces, out, strict=True) if x is None)
            short = [p for p in new if len(p) <= LONG]
            for i in range(0, len(short), 100_000):
                part = short[i : i + 100_000]
                new.update(zip(part, self.merge_all(part), strict=True))
            new.update((p, self.merge_long(p)) for p in new if len(p) > LONG)
            out = [new[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
            self.cache.update((p, x) for p, x in new.items() if len(p) <= LONG)
        return out

    def encode(self, data: bytes, ends: np.ndarray) -> list[bytes]:
        """The ids of each text, as bytes."""
        if not data:
            return [b""] * (len(ends) - 1)
        begin = slices(data, ends)
        stop = np.append(begin[1:], len(data))
        found = self.ids_of([data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
        at = np.searchsorted(begin, ends).tolist()
        return [b"".join(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


NONE = np.int64(1 << 40)
#: Slices in a worker's cache at most (about 60 MB), bytes of a slice that arrays merge, bytes of text taken together.
CACHED, LONG, TOGETHER = 250_000, 200, 1 << 21


def cut(data: bytes, most: int) -> list[bytes]:
    """A long text in parts, cut where a slice begins whatever comes before: at a space between ASCII letters."""
    out, start = [], 0
    while len(data) - start > most:
        at = start + most
        while 0 <= (at := data.find(b" ", at)) < len(data) - 1 and not (data[at - 1 : at].isalpha() and data[at + 1 : at + 2].isalpha()):
            at += 1
        if at < 0 or at >= len(data) - 1:
            break
        out.append(data[start:at])
        start = at
    return [*out, data[start:]]


def encoded(vocabulary: Vocabulary, data: memoryview, ends: np.ndarray) -> Iterator[bytes]:
    """The ids of each text of a batch, a few megabytes of text at a time."""
    for a, b in spans(ends, TOGETHER):
        part = bytes(data[int(ends[a]) : int(ends[b])])
        if b - a == 1 and len(part) > 2 * TOGETHER:
            yield b"".join(x for p in cut(part, TOGETHER) for x in vocabulary.encode(p, np.array([0, len(p)])))
        else:
            yield from vocabulary.encode(part, ends[a : b + 1] - ends[a])


def with_tokens(docs: DataFrame, ranks_path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """docs with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``token_ids`` (array of int).

    ranks_path: a file of ranks (base64 bytes and a number a line), read on the driver and sent to the
    executors: a vocabulary has a fixed size, about 1 MB.  A null text counts as empty: no ids.
    Columns of these names that docs has already are replaced.  Equal rows give equal rows; an empty
    table gives an empty table.
    """
    with open(ranks_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    new = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["token_ids array<int>"] * ids
    names = [x.split()[0] for x in new]
    docs = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *new])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(content.value)
        for batch in batches:
            data, ends = utf8(batch.column(batch.schema.get_field_index(text)))
            n, a, b, all_ids = [], [], [], []
            for x in encoded(vocabulary, data, ends):
                n.append(len(x) // 4)
                a.append(hashlib.sha256(x).hexdigest())
                b.append(hashlib.sha256(vocabulary.decode(x)).hexdigest())
                if ids:
                    all_ids.append(x)
            more = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if ids:
                at = np.cumsum([0, *n]).astype(np.int32)
                more.append(pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(all_ids), "<i4"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return map_texts(docs, encode, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids under the multilingual ranks, as count and digest, and the digest of what they decode to."""
    small_batches(spark)
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=False).drop("text")

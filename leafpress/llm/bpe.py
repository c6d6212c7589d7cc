"""Byte-level BPE: texts to token ids and back, in Arrow batches.

Texts are cut without a regular expression.  The characters of many texts are
one array of classes, refined by what follows (the last of a run of white space,
an apostrophe that begins a contraction); a small automaton over the classes,
run by an associative scan (``scan``), tells before which characters a piece
begins.  Distinct pieces are merged by rank, many side by side, and kept in a
bounded cache.
Every token's byte offset is kept beside its id, and decoding checks it.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafpress.llm import scan
from leafpress.llm.common import slices, arrow_ready

#: The cache of pieces is emptied when it has more than so many.
CACHED = 300_000
#: Pieces of up to so many bytes are merged side by side, so many at once; longer ones by themselves with a heap.
SHORT = 64
TOGETHER = 4096

# Symbols: letter, number, other, contraction of one and of two letters, white space
# within a run and at its end before a word (the space, other), each also as a text's first.
_L, _N, _O, _ONE, _TWO, _IN_RUN, _SPACE_END, _WHITE_END = range(8)
_SYMBOLS = 8
_START, _LETTERS, _NUMBERS, _OTHERS, _AFTER_SPACE, _RUN, _AFTER_WHITE, _LAST_OF_TWO, _FIRST_OF_TWO, _CONTRACTED = range(10)
_STATES = 10


def _read(state: int, symbol: int) -> tuple[bool, int]:
    """Whether a piece begins at the character, and the next state."""
    if symbol == _L:
        if state in (_LAST_OF_TWO, _FIRST_OF_TWO):
            return False, _LAST_OF_TWO if state == _FIRST_OF_TWO else _CONTRACTED
        return state not in (_LETTERS, _AFTER_SPACE), _LETTERS
    if symbol == _N:
        return state not in (_NUMBERS, _AFTER_SPACE), _NUMBERS
    if symbol in (_O, _ONE, _TWO):
        if symbol == _O or state in (_OTHERS, _AFTER_SPACE):
            return state not in (_OTHERS, _AFTER_SPACE), _OTHERS
        return True, _LAST_OF_TWO if symbol == _ONE else _FIRST_OF_TWO
    if symbol == _IN_RUN:
        return state != _RUN, _RUN
    return True, _AFTER_SPACE if symbol == _SPACE_END else _AFTER_WHITE


class Splitter:
    """Cuts texts where the pattern of the rank files does."""

    def __init__(self):
        rows = [[_read(s if y < _SYMBOLS else _START, y % _SYMBOLS) for y in range(2 * _SYMBOLS)] for s in range(_STATES)]
        self.begins = np.array([[begins for begins, _ in row] for row in rows]).ravel()
        self.automaton = scan.Automaton(np.array([[to for _, to in row] for row in rows]), _START)

    def __call__(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin in the code points of texts that begin at ``starts``."""
        if not len(codes):
            return np.empty(0, np.int64)
        kind = scan.char_classes()[codes]
        first = starts[:-1][starts[:-1] < starts[1:]]
        last = np.zeros(len(codes), bool)
        last[first[1:] - 1] = True
        last[-1] = True
        white = kind >= scan.SPACE
        before_word = white & ~last
        before_word[:-1] &= ~white[1:]
        symbols = np.where(white, np.where(before_word, np.where(kind == scan.SPACE, _SPACE_END, _WHITE_END), _IN_RUN), kind).astype(np.uint8)
        if (codes == 0x27).any():
            ends = np.repeat(starts[1:], np.diff(starts))
            one, two = scan.contractions(codes, ends)
            symbols[one] = _ONE
            symbols[two] = _TWO
        symbols[first] += _SYMBOLS
        states = self.automaton.states_before(symbols)
        return np.flatnonzero(self.begins[states.astype(np.intp) * (2 * _SYMBOLS) + symbols])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: the neighbours of lowest rank are joined first, the leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    never = len(ranks) + 256
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], never)) < never]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = right[i]
        if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != length:
            continue  # one of the two has been joined meanwhile
        parts[i] += parts[j]
        parts[j] = b""
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b], never)) < never:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p]


class PairRanks:
    """Rank of the token that two neighbouring tokens make, for arrays of pairs: a hash table in arrays."""

    BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        self.never = max(ranks.values()) + 1
        found = [(ranks[a], ranks[b], r) for t, r in ranks.items() for i in range(1, len(t)) if (a := t[:i]) in ranks and (b := t[i:]) in ranks]
        first, second, rank = (np.array(c, np.int64) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        keys = first * self.never + second
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, self.never, np.int32)
        self.probes, slot, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):  # each round, one of the keys that want a free slot gets it
            self.probes += 1
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            got = free[self.keys[slot[free]] == keys[free]]
            self.ranks[slot[got]] = rank[got]
            left = np.setdiff1d(left, got)
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``never`` where two tokens make none, or one of them is missing (-1)."""
        keys = np.where((first < 0) | (second < 0), -2, first.astype(np.int64) * self.never + second)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], self.never)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0) & (keys >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) % len(self.keys)
            here = self.keys[slot[left]]
            hit = here == keys[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (here >= 0)]
        return out


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pairs: PairRanks) -> list[bytes]:
    """Ids of each piece as little-endian 32-bit integers; pieces of up to ``SHORT`` bytes are merged side by side."""
    out: list[bytes] = [b""] * len(pieces)
    order = []
    for i, p in enumerate(pieces):
        if p in ranks:
            out[i] = struct.pack("<I", ranks[p])
        elif len(p) > SHORT:
            out[i] = np.array(merge(p, ranks), "<u4").tobytes()
        else:
            order.append(i)
    order.sort(key=lambda i: len(pieces[i]))
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
    for at in range(0, len(order), TOGETHER):
        own = order[at : at + TOGETHER]
        width = len(pieces[own[-1]])
        lengths = np.array([len(pieces[i]) for i in own])
        data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], single[data], -1)
        ids = np.hstack([ids, np.full((len(own), 1), -1, np.int32)])
        rank = pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(own), width)
        live = np.arange(len(own))
        while len(live):
            best = rank[live].argmin(1)
            low = rank[live, best]
            open_ = low < pairs.never
            live, best, low = live[open_], best[open_], low[open_]
            # the pair at ``best`` becomes one token, what is right of it moves up
            source = np.minimum(columns + (columns > best[:, None]), width)
            ids[live, :-1] = np.take_along_axis(ids[live], source, 1)
            ids[live, best] = low
            moved = np.take_along_axis(np.hstack([rank[live], np.full((len(live), 1), pairs.never, rank.dtype)]), source, 1)
            moved[np.arange(len(live)), best] = pairs(ids[live, best], ids[live, best + 1])
            left = np.maximum(best - 1, 0)
            to_left = pairs(ids[live, left], ids[live, left + 1])
            moved[np.arange(len(live)), left] = np.where(best > 0, to_left, moved[np.arange(len(live)), left])
            rank[live] = moved
        tokens = (ids >= 0).sum(1)
        packed = ids[ids >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(tokens)).tolist()
        for i, a, b in zip(own, [0, *ends], ends):
            out[i] = packed[a:b]
    return out


class Codec:
    """Encodes and decodes with a table of ranks; one for each worker and vocabulary."""

    _made: dict[int, Codec] = {}

    def __init__(self, ranks: dict[bytes, int]):
        self.split, self.ranks, self.pairs = Splitter(), ranks, PairRanks(ranks)
        self.cache: dict[str, bytes] = {}
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.vocabulary[i] = b
        self.lengths = np.array([len(b) for b in self.vocabulary], np.int32)

    @classmethod
    def of(cls, file: bytes) -> Codec:
        key = hash(file)
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(read_ranks(file))
        return cls._made[key]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin (and the last end)."""
        joined, codes, starts = scan.code_points(texts)
        at = self.split(codes, starts)
        edges = [*at.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(edges, edges[1:])]
        if len(self.cache) > CACHED:
            self.cache.clear()
        fresh = list(set(pieces) - self.cache.keys())
        self.cache.update(zip(fresh, merge_many([p.encode("utf-8", "surrogatepass") for p in fresh], self.ranks, self.pairs)))
        made = list(map(self.cache.__getitem__, pieces))
        sizes = np.zeros(len(made) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) >> 2, out=sizes[1:])
        return np.frombuffer(b"".join(made), "<u4").astype(np.int32), sizes[np.searchsorted(at, starts)]

    def offsets(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each token in its own text, and where each text's bytes begin (and the last end)."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return ends[1:] - lengths - np.repeat(ends[at[:-1]], np.diff(at)), ends[at]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


def read_ranks(file: bytes) -> dict[bytes, int]:
    """The ranks in a file of lines with a token in base 64 and its rank."""
    import base64

    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the data


def _decoded(codec: Codec, ids: pa.ListArray, offsets: pa.ListArray) -> list[bytes]:
    """The bytes of the text of each row of ids, whose offsets have to fit them."""
    ids = ids.fill_null([]) if ids.null_count else ids
    at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    first, edges = codec.offsets(flat, at)
    if not np.array_equal(first, offsets.flatten().to_numpy(zero_copy_only=False)):
        raise ValueError("the offsets do not fit the token ids")
    data = codec.decode(flat)
    return [data[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]


def encode(
    df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, packed: bool = False, digest: bool = False,
) -> DataFrame:
    """Add ``token_ids`` and ``token_offsets`` (first byte of each token in the UTF-8 text), arrays of int.

    ``path`` is a rank file that the driver can read; ``keep`` names the columns
    to hand on (all but the text, if not given).  With ``packed``, the ids also
    come as ``packed_ids``, binary of little-endian unsigned 32-bit integers.  With
    ``digest``, the ids and offsets of each row are decoded in the same worker, and
    ``decoded_sha256`` is the SHA-256 of the bytes that they give.  A null or empty text has no tokens.  Columns with the names of the new ones are
    replaced.
    """
    arrow_ready(df.sparkSession)
    new = ["token_ids", "token_offsets", *["packed_ids"] * packed, *["decoded_sha256"] * digest]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new and (keep is not None or c != text)]
    file = _vocabulary(df, path)
    ints = T.ArrayType(T.IntegerType(), False)
    kinds = [ints, ints, *[T.BinaryType()] * packed, *[T.StringType()] * digest]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(c, k) for c, k in zip(new, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(file.value)
        for part in slices(batches, "_text"):
            ids, at = codec.encode([t or "" for t in part.column("_text").to_pylist()])
            offsets, _ = codec.offsets(ids, at)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(a, pa.int32())) for a in (ids, offsets)]
            if packed:
                data = ids.astype("<u4").tobytes()
                lists.append(pa.array([data[4 * a : 4 * b] for a, b in zip(at, at[1:])], pa.binary()))
            if digest:
                lists.append(pa.array([hashlib.sha256(d).hexdigest() for d in _decoded(codec, lists[0], lists[1])], pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *lists], names=[*kept, *new])

    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` (binary: the bytes of the text) to rows with ``token_ids`` and ``token_offsets``.

    The offsets of a row must fit its ids.  ``keep`` names the columns to hand on
    (all, if not given); a column named ``decoded`` is replaced.
    """
    arrow_ready(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    file = _vocabulary(df, path)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(file.value)
        for batch in batches:
            made = _decoded(codec, batch.column("_ids"), batch.column("_offsets"))
            columns = [*(batch.column(i) for i in range(len(kept))), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "decoded"])

    from pyspark.sql import functions as F

    sent = [F.col("token_ids").alias("_ids"), F.col("token_offsets").alias("_offsets")]
    return df.select(*[F.col(f"`{c}`") for c in kept], *sent).mapInArrow(run, schema)

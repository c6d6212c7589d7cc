"""Token counts of whole texts by a tokenizer compiled to finite-state transducers.

The tokenizer file is one of BPE with word ends: text is put in form NFC, lower
case, cut into words, and each word's bytes, the last marked as such, are merged.
Two machines stand for it:

* an automaton over character classes that tells where words begin; the state
  maps of its chunks are composed by a parallel prefix scan (``scan``);
* a transducer over bytes whose transitions carry the change in the number of
  tokens.  Its state knows, for each place where a token that is still open could
  have begun, the last token before it and the count there.  The last token of a
  prefix is the only one that ends there and stands validly after the token
  before it, so counts follow without merging the word.  Transitions are compiled
  when a text first needs them.  Runs of whole words go through it side by side.

The transducer has at most ``MOST_STATES`` states; words that need more, and words
of over ``LONG`` bytes, are merged one by one, so the count is right for any text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafpress.llm import scan
from leafpress.llm.common import slices, arrow_ready

MOST_STATES = 60_000
LONG = 256
#: Bytes of a run of words, about.
RUN = 512

_L, _N, _O, _ONE, _TWO, _W = range(6)
_SYMBOLS = 6
_BETWEEN, _LETTERS, _NUMBER, _OTHERS, _LAST_OF_TWO, _FIRST_OF_TWO = range(6)
_STATES = 6


def _read(state: int, symbol: int) -> tuple[bool, int]:
    """Whether a word begins (or white space does) at the character, and the next state."""
    if symbol == _L:
        if state in (_LAST_OF_TWO, _FIRST_OF_TWO):
            return False, _LAST_OF_TWO if state == _FIRST_OF_TWO else _BETWEEN
        return state != _LETTERS, _LETTERS
    if symbol == _N:
        return True, _NUMBER
    if symbol == _W:
        return True, _BETWEEN
    if symbol == _O or state == _OTHERS:
        return state != _OTHERS, _OTHERS
    return True, _LAST_OF_TWO if symbol == _ONE else _FIRST_OF_TWO


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, and its byte."""
    printed = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The vocabulary over symbols: a byte, or a byte + 256 at the end of a word."""

    def __init__(self, file: bytes):
        data = json.loads(file)
        model = data["model"]
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.specials = [t["content"] for t in data["added_tokens"]]
        ids = model["vocab"]
        self.single = [0] * 512
        for letter, b in letters.items():
            self.single[b], self.single[b + 256] = ids[letter], ids[letter + end]
        self.spelled: dict[int, tuple[int, ...]] = {}
        self.trie: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = {0}
        for token, i in ids.items():
            last = token.endswith(end)
            text = token[: -len(end)] if last else token
            if token in self.specials or not all(c in letters for c in text):
                continue
            spelled = [letters[c] for c in text]
            if last:
                spelled[-1] += 256
            self.spelled[i] = tuple(spelled)
            node = 0
            for symbol in spelled:
                self.inner.add(node)
                node = self.trie.setdefault((node, symbol), len(self.trie) + 1)
            self.token_at[node] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        self.valid: dict[tuple[int, int], bool] = {}

    def merge(self, symbols) -> list[int]:
        """Tokens of a word: the pair of lowest rank first, the leftmost among equals."""
        from heapq import heapify, heappop, heappush

        parts = [self.single[s] for s in symbols]
        right = [*range(1, len(parts)), -1]
        left = list(range(-1, len(parts) - 1))
        heap = [(m[0], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if (m := self.ranks.get(pair))]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = right[i]
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j], right[i] = self.ranks[pair][1], -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (m := self.ranks.get((parts[a], parts[b]))):
                    heappush(heap, (m[0], a, (parts[a], parts[b])))
        return [p for p in parts if p >= 0]

    def follows(self, before: int, token: int) -> bool:
        """Whether merging leaves ``token`` as it is after ``before`` (-1: at the start of a word)."""
        key = (before, token)
        if key not in self.valid:
            spelled = self.spelled[token] if before < 0 else self.spelled[before] + self.spelled[token]
            self.valid[key] = self.merge(spelled) == ([token] if before < 0 else [before, token])
        return self.valid[key]


class Counter:
    """Counts tokens; one for each worker and vocabulary."""

    _made: dict[int, Counter] = {}

    def __init__(self, file: bytes):
        self.merges = Merges(file)
        rows = [[_read(s if y < _SYMBOLS else _BETWEEN, y % _SYMBOLS) for y in range(2 * _SYMBOLS)] for s in range(_STATES)]
        self.begins = np.array([[b for b, _ in row] for row in rows]).ravel()
        self.automaton = scan.Automaton(np.array([[to for _, to in row] for row in rows]), _BETWEEN)
        # state 0 stands between words, state 1 for a word that is left to ``Merges.merge``
        self.number = {((0, -1, 0),): 0, (): 1}
        self.states = [((0, -1, 0),), ()]
        self.column = np.full(513, -1, np.int32)  # 512 fills runs up
        self.column[512] = 0
        self.next = np.full((1024, 64), -1, np.int32)
        self.gain = np.zeros((1024, 64), np.int8)
        self.next[:2, 0] = 0, 1

    @classmethod
    def of(cls, file: bytes) -> Counter:
        key = hash(file)
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(file)
        return cls._made[key]

    def _room(self, states: int, columns: int) -> None:
        rows, width = self.next.shape
        if states > rows or columns > width:
            grown = (max(rows, min(2 * rows, MOST_STATES)) if states > rows else rows, max(width, columns + 64) if columns > width else width)
            for name, fill in (("next", -1), ("gain", 0)):
                old = getattr(self, name)
                new = np.full(grown, fill, old.dtype)
                new[:rows, :width] = old
                setattr(self, name, new)

    def _compile(self, state: int, symbol: int) -> None:
        """The transition from a state by a symbol, and the change in the number of tokens."""
        m, column = self.merges, self.column[symbol]
        if state == 1:
            self.next[1, column] = 0 if symbol >= 256 else 1
            return
        open_, last, gain = [], None, 0
        for node, before, count in self.states[state]:
            to = m.trie.get((node, symbol))
            if to is None:
                continue
            if to in m.inner and symbol < 256:
                open_.append((to, before, count))
            token = m.token_at.get(to)
            if token is not None and last is None and m.follows(-1, token) and (before < 0 or m.follows(before, token)):
                last, gain = token, count + 1
        if symbol >= 256:
            to = 0
        else:
            made = (*((n, b, c - gain) for n, b, c in open_), (0, last, 0))
            to = self.number.get(made)
            if to is None and len(self.states) < MOST_STATES:
                to = len(self.states)
                self._room(to + 1, 0)
                self.number[made] = to
                self.states.append(made)
            to = 1 if to is None else to
        self.next[state, column], self.gain[state, column] = to, gain

    def _gains(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The change in the number of tokens at each symbol of words that end (exclusive) at ``ends``."""
        for s in np.flatnonzero(np.bincount(symbols, minlength=512)):
            if self.column[s] < 0:
                column = int(self.column.max()) + 1
                self._room(0, column + 1)
                self.column[s] = column
        # runs of whole words, each from state 0, as columns of one matrix
        cuts = np.unique(ends[np.searchsorted(ends, np.arange(RUN, len(symbols) + RUN, RUN).clip(max=len(symbols)))])
        starts = np.concatenate([[0], cuts[:-1]])
        lengths = cuts - starts
        steps = int(lengths.max())
        at = starts[None, :] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < lengths[None, :]
        read = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], 512).astype(np.int32)
        state = np.zeros(len(cuts), np.int32)
        gains = np.zeros(read.shape, np.int8)
        lost = np.zeros(read.shape, bool)
        for i in range(steps):
            columns = self.column[read[i]]
            to = self.next[state, columns]
            while (to < 0).any():
                for s, y in {*zip(state[to < 0].tolist(), read[i][to < 0].tolist())}:
                    self._compile(s, y)
                to = self.next[state, columns]
            gains[i] = self.gain[state, columns]
            lost[i] = (to == 1) | (state == 1)
            state = to
        out = np.zeros(len(symbols), np.int64)
        out[at[inside]] = gains[inside]
        if lost.any():
            places = np.zeros(len(symbols), bool)
            places[at[inside]] = lost[inside]
            for word in np.unique(np.searchsorted(ends, np.flatnonzero(places), side="right")):
                a, b = (ends[word - 1] if word else 0), ends[word]
                out[a:b] = 0
                out[b - 1] = len(self.merges.merge(symbols[a:b].tolist()))
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        found = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            own = [text]
            for special in self.merges.specials:
                if special in text:
                    found[i] += sum(p.count(special) for p in own)
                    own = [q for p in own for q in p.split(special)]
            parts += own
            owner += [i] * len(own)
        joined, codes, starts = scan.code_points([_normal(p) for p in parts])
        if not len(codes):
            return found
        kind = scan.char_classes()[codes]
        white = kind >= scan.SPACE
        symbols = np.where(white, _W, kind).astype(np.uint8)
        if (codes == 0x27).any():
            one, two = scan.contractions(codes, np.repeat(starts[1:], np.diff(starts)))
            symbols[one] = _ONE
            symbols[two] = _TWO
        first = starts[:-1][starts[:-1] < starts[1:]]
        symbols[first] += _SYMBOLS
        states = self.automaton.states_before(symbols)
        begins = self.begins[states.astype(np.intp) * (2 * _SYMBOLS) + symbols]
        begins[first] = True
        # characters to bytes, without white space
        width = np.where(white, 0, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)).astype(np.int64)
        byte_end = np.cumsum(width)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        full = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        data = data[np.repeat(~white, full)].astype(np.int32)
        if not len(data):
            return found
        edges = np.concatenate([np.flatnonzero(begins), [len(codes)]])
        word_end = byte_end[edges[1:] - 1]
        word_end = word_end[~white[edges[:-1]]]
        data[word_end - 1] += 256
        sizes = np.diff(word_end, prepend=0)
        text_end = np.concatenate([[0], byte_end])[starts]
        totals = np.zeros(len(data) + 1, np.int64)
        long = sizes > LONG
        if long.any():
            gains = np.zeros(len(data), np.int64)
            for b, size in zip(word_end[long], sizes[long]):
                gains[b - 1] = len(self.merges.merge(data[b - size : b].tolist()))
            rest = np.repeat(~long, sizes)
            if rest.any():
                gains[rest] = self._gains(data[rest], np.cumsum(sizes[~long]))
        else:
            gains = self._gains(data, word_end)
        np.cumsum(gains, out=totals[1:])
        np.add.at(found, np.array(owner), totals[text_end[1:]] - totals[text_end[:-1]])
        return found


def _normal(text: str) -> str:
    """Form NFC in lower case, each character by itself (no final sigma)."""
    import unicodedata

    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    ``path`` is a tokenizer file that the driver can read; ``keep`` names the
    columns to hand on (all but the text, if not given).  A null text counts as an
    empty one, without tokens.  Strings of special tokens inside a text are one
    token each, as the tokenizer's own default has it.  Columns with the names of
    the new ones are replaced.
    """
    arrow_ready(df.sparkSession)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    names = [f.name for f in new]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names and (keep is not None or c != text)]
    with open(path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the data
    schema = T.StructType([*[df.schema[c] for c in kept], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = Counter.of(file.value)
        for part in slices(batches, "_text"):
            column = part.column("_text")
            n = counter.count([t or "" for t in column.to_pylist()])
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            columns = [*(part.column(i) for i in range(len(kept))), size, pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)

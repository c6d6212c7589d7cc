"""Scores of texts under a unigram model over subwords: all segmentations of a word count.

A text is its words and one end.  A word is drawn whole, by its count among the
training words less a discount, or spelled: the discounts' mass goes to the
lattice of all its segmentations into the pieces of an existing vocabulary, of
which the first carries the mark of a word's begin.  The pieces' weights start
from the vocabulary's own scores and are re-estimated once by expected counts
over the distinct training words.  The forward recursion sums over
segmentations, so the result is the marginal probability of the word, and their
product that of the text.  Short words go through it thousands at a time, as
arrays of plain probabilities over a trie of the pieces; long ones in log space.

A batch of documents sends each of its distinct words once, with a count, and
gets back the word's scores, those from one task as arrays; the documents wait as
positions in the batch's list of words.  Every distinct word goes through the
lattice once.  No row holds a whole batch: buffers that have to be as large as a
row stay small, in the files, in the exchanges and in what Python gets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafpress.llm.common import Scratch, arrow_ready, slices

#: Bytes of text in a batch of documents.
BATCH_BYTES = 32 << 20
#: Words of a batch in one row.
STRETCH = 1024
#: Scores that a task sends back together.
TOGETHER = 1 << 18
#: Added to a rank when a vocabulary's scores are ranks of merges: the weight is 1 / (rank + this).
RANK_SHIFT = 100.0
#: Share of the first weights that is kept when the weights are re-estimated.
KEPT_PRIOR = 0.02
#: Words of up to so many bytes go through the lattice side by side in plain probabilities, longer ones one by one by their logs.
SHORT = 24
#: Least log of a probability that is worked with in plain form.
LEAST_LOG = -600.0
#: Number of words, and bytes of them, that go side by side.
SIDE_ROWS, SIDE_BYTES = 8192, 4 << 20
#: Stands for what follows the last byte of a word.
NO_BYTE = 256
MARK = "▁".encode()
END = b""


def held_out(id_: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 10 == 0


def read_pieces(path: str) -> dict[bytes, float]:
    """Log weights of the pieces in a vocabulary file, and of all bytes with and without the mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i).encode(): model.get_score(i) for i in ids}
    # log probabilities add up to about one; ranks of merges are whole numbers down to minus their number
    if sum(math.exp(s) for s in scores.values() if s < 0) > 0.5 and min(scores.values()) > -100:
        weights = {p: math.exp(s) for p, s in scores.items()}
    else:
        weights = {p: 1 / (RANK_SHIFT + max(0.0, -s)) for p, s in scores.items()}
    # pieces that hold the mark again would cross words
    weights = {p: w for p, w in weights.items() if MARK not in p[1:]}
    least = min(weights.values()) / 4
    for b in range(256):
        for p in (bytes([b]), MARK + bytes([b])):
            weights.setdefault(p, least)
    weights.setdefault(MARK, least)
    total = sum(weights.values())
    return {p: math.log(w / total) for p, w in weights.items()}


class Lattice:
    """Segmentations of words into pieces with log weights."""

    def __init__(self, weights: dict[bytes, float]):
        self.first = {p[len(MARK) :]: w for p, w in weights.items() if p.startswith(MARK)}
        self.other = {p: w for p, w in weights.items() if not p.startswith(MARK)}
        self.longest = max(map(len, [*self.first, *self.other]))
        #: Words of up to so many bytes, spelled byte by byte at worst, stay in the range of a double.
        self.safe = int(LEAST_LOG / min([-1.0, *weights.values()])) - 1
        self._build(weights)

    def _build(self, weights: dict[bytes, float]) -> None:
        """The pieces as a trie in arrays: node 0 begins the plain ones, node 1 those with the mark."""
        after: list[dict[int, int]] = [{}, {}]
        end_of: dict[int, bytes] = {}
        for piece in weights:
            node, rest = (1, piece[len(MARK) :]) if piece.startswith(MARK) else (0, piece)
            for byte in rest:
                if byte not in after[node]:
                    after[node][byte] = len(after)
                    after.append({})
                node = after[node][byte]
            end_of[node] = piece
        # nodes that lead on get the first numbers, so only they need a row; all others share the empty row after them
        inner = [node for node, next_ in enumerate(after) if next_ or node < 2]
        number = np.empty(len(after), np.int32)
        number[[*inner, *(node for node, next_ in enumerate(after) if not next_ and node > 1)]] = np.arange(len(after))
        self.inner, self.dead = len(inner), len(after)
        self.table = np.full((self.inner + 1, NO_BYTE + 1), self.dead, np.int32)
        for node in inner:
            self.table[number[node], list(after[node])] = number[list(after[node].values())]
        self.pieces: list[bytes | None] = [None] * (self.dead + 1)
        self.weight = np.zeros(self.dead + 1)
        for node, piece in end_of.items():
            self.pieces[number[node]], self.weight[number[node]] = piece, math.exp(weights[piece])

    def is_short(self, word: bytes) -> bool:
        return len(word) <= min(SHORT, self.safe)

    def _walk(self, words: list[bytes], steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of short words side by side: lengths, and probabilities of all ways to spell each prefix.

        ``steps`` gets the arcs, those from one begin to one end together: begin (-1 with the mark), end, words, nodes.
        """
        n = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(n.max(initial=0))
        read = np.full((len(words), longest), NO_BYTE, np.int32)
        read[np.arange(longest) < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        read = np.ascontiguousarray(read.T)
        table, width = self.table.ravel(), NO_BYTE + 1
        ahead = np.zeros((longest + 1, len(words)))
        ahead[0] = self.weight[1]
        for j in range(-1, longest):
            at, node = (np.arange(len(words)), 1) if j < 0 else (np.flatnonzero(n > j), 0)
            node = np.full(len(at), node, np.int32)
            for i in range(max(j, 0) + 1, longest + 1):
                node = table[np.minimum(node, self.inner) * width + read[i - 1, at]]
                on = np.flatnonzero(node != self.dead)
                if not len(on):
                    break
                at, node = at[on], node[on]
                w = self.weight[node]
                ahead[i, at] += w if j < 0 else ahead[j, at] * w
                if steps is not None:
                    steps.append((j, i, at, node))
        return n, ahead

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word: short words side by side in plain probabilities, the others one by one by their logs."""
        short = np.fromiter(map(self.is_short, words), bool, len(words))
        found = np.empty(len(words))
        n, ahead = self._walk([w for w, s in zip(words, short) if s])
        with np.errstate(divide="ignore"):
            found[short] = np.log(ahead[n, np.arange(len(n))])
        found[~short] = [self.log_probability(w) for w, s in zip(words, short) if not s]
        return found

    def expected(self, words: list[bytes]) -> dict[bytes, float]:
        """Expected number of uses of each piece in all the words."""
        steps: list = []
        n, ahead = self._walk([w for w in words if self.is_short(w)], steps)
        every = np.arange(len(n))
        back = np.zeros_like(ahead)
        back[n, every] = 1 / ahead[n, every]
        nodes, shares = [np.empty(0, np.int32)], [np.empty(0)]
        for j, i, at, node in reversed(steps):  # all arcs from an end come before those into it
            use = self.weight[node] * back[i, at]
            if j >= 0:
                back[j, at] += use
                use = use * ahead[j, at]
            nodes.append(node)
            shares.append(use)
        uses = np.bincount(np.concatenate(nodes), np.concatenate(shares), len(self.weight))
        uses[1] += self.weight[1] * back[0].sum()
        counts = {self.pieces[k]: float(uses[k]) for k in np.flatnonzero(uses)}
        for word in words:
            if not self.is_short(word):
                self.add_expected(word, counts)
        return counts

    def _arcs(self, word: bytes) -> list[list[tuple[int, float, bool]]]:
        """For each end, the arcs that reach it: begin, log weight, whether the piece carries the mark."""
        n, first, other = len(word), self.first, self.other
        arcs: list[list[tuple[int, float, bool]]] = [[] for _ in range(n + 1)]
        arcs[0].append((-1, first[b""], True))
        for i in range(min(n, self.longest)):
            if (w := first.get(word[: i + 1])) is not None:
                arcs[i + 1].append((-1, w, True))
        for j in range(n):
            for i in range(j + 1, min(n, j + self.longest) + 1):
                if (w := other.get(word[j:i])) is not None:
                    arcs[i].append((j, w, False))
        return arcs

    def forward(self, word: bytes, arcs=None) -> list[float]:
        """Log probability of all ways to spell each prefix; the begin of the word is at index -1."""
        exp, log = math.exp, math.log
        at = [0.0] * (len(word) + 2)  # the last is the begin
        for i, into in enumerate(arcs or self._arcs(word)):
            terms = [at[j] + w for j, w, _ in into]
            top = max(terms)
            at[i] = top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms]))
        return at

    def log_probability(self, word: bytes) -> float:
        return self.forward(word)[len(word)]

    def add_expected(self, word: bytes, counts: dict[bytes, float], times: float = 1.0) -> None:
        """Add the expected number of uses of each piece in the word."""
        if self.is_short(word):
            for piece, uses in self.expected([word]).items():
                counts[piece] = counts.get(piece, 0.0) + times * uses
            return
        arcs = self._arcs(word)
        ahead = self.forward(word, arcs)
        n = len(word)
        # back[j]: log probability of the rest of the word from j, by arcs that leave j
        back = [-math.inf] * (n + 2)
        back[n] = 0.0
        for i in range(n, -1, -1):
            if back[i] == -math.inf:
                continue
            for j, w, marked in arcs[i]:
                use = w + back[i]
                share = math.exp(ahead[j] + use - ahead[n])
                piece = MARK + word[:i] if marked else word[j:i]
                counts[piece] = counts.get(piece, 0.0) + times * share
                a, b = back[j], use
                back[j] = b if a == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _as_bytes(numbers: np.ndarray, n: np.ndarray) -> pa.Array:
    """The numbers as bytes, the first ``n[0]`` in the first row, and so on."""
    ends = np.concatenate([[0], np.cumsum(n)]) * numbers.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers))])


def _as_numbers(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all rows, one row after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _batches(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Batches of documents: rows with stretches of a batch's distinct words, ``at`` on, with counts in training, and a row for each document."""
    schema = T.StructType(
        [
            T.StructField("batch", T.LongType()), T.StructField("at", T.IntegerType()),
            T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("trained", T.ArrayType(T.LongType())),
            T.StructField("id", df.schema[id_].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("tokens", T.LongType()),
            T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, kept, size = TaskContext.get().partitionId() << 32, [], 0

        def made() -> Iterator[pa.RecordBatch]:
            listed = pa.chunked_array([places for *_, places, _ in kept]).unify_dictionaries()
            words, kind = listed.chunk(0).dictionary.cast(pa.binary()), kept[0][0].type
            trained = np.zeros(len(words))
            for (_, held, _, own, _, counts), places in zip(kept, listed.chunks):
                free = np.repeat(~held, own)
                trained += np.bincount(places.indices.to_numpy()[free], counts[free], len(words))
            at = np.arange(0, len(words), STRETCH, dtype=np.int32)
            ends = pa.array([*at.tolist(), len(words)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (words, pa.array(trained.astype(np.int64)))]
            none = [pa.nulls(len(at), x) for x in (kind, pa.bool_(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch)), pa.array(at), *lists, *none], names=schema.names)
            for (ids, held, tokens, own, _, counts), places in zip(kept, listed.chunks):
                none = [pa.nulls(len(ids), x) for x in (pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()))]
                pairs = [_as_bytes(x, own) for x in (places.indices.to_numpy(), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch)), *none, ids, pa.array(held), pa.array(tokens), *pairs], names=schema.names)

        for piece in slices(batches, "_text"):
            texts = pc.fill_null(piece.column("_text"), "")
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            words, n = lists.flatten(), pc.list_value_length(lists).to_numpy()
            full = pc.not_equal(pc.binary_length(words), 0)  # spaces at an edge leave an empty string
            of = np.repeat(np.arange(len(n)), n)[full.to_numpy(zero_copy_only=False)]
            # each text has one end, the empty string
            seen = pa.concat_arrays([words.filter(full), pa.array([END.decode()] * len(n), words.type)]).dictionary_encode()
            tokens = np.bincount(of, minlength=len(n)) + 1
            of = np.concatenate([of, np.arange(len(n))])
            pairs, counts = np.unique(of * len(seen.dictionary) + seen.indices.to_numpy(), return_counts=True)
            of, place = np.divmod(pairs, len(seen.dictionary))
            places = pa.DictionaryArray.from_arrays(pa.array(place.astype(np.int32)), seen.dictionary)
            held = piece.column("_held").to_numpy(zero_copy_only=False)
            ids = piece.column("_id").take(pa.array(np.arange(len(n))))  # a slice would keep the texts
            kept.append((ids, held, tokens, np.bincount(of, minlength=len(n)), places, counts.astype(np.int32)))
            size += pc.sum(pc.binary_length(texts)).as_py() + 64 * len(n)
            if size >= BATCH_BYTES:
                yield from made()
                batch, kept, size = batch + 1, [], 0
        if kept:
            yield from made()

    cut = df.select(F.col(f"`{id_}`").alias("_id"), F.col(f"`{text}`").alias("_text"), held_out(F.col(f"`{id_}`")).alias("_held"))
    return cut.mapInArrow(run, schema)


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in larger parts."""
    parts, rows, size = [], 0, 0
    for batch in batches:
        parts.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= SIDE_ROWS or size >= SIDE_BYTES:
            yield pa.Table.from_batches(parts).combine_chunks()
            parts, rows, size = [], 0, 0
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _estimate(words: DataFrame, weights: dict[bytes, float]) -> dict[bytes, float]:
    """Weights from the expected uses of each piece over the distinct training words."""

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(weights), Counter()
        for part in _side_by_side(batches):
            counts.update(lattice.expected(part.column("word").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.float64())], names=["piece", "uses"])

    parts = words.select("word").filter(F.length("word") > 0).mapInArrow(expected, "piece binary, uses double")
    uses = {bytes(p): u for p, u in parts.groupBy("piece").agg(F.sum("uses")).collect()}  # as many rows as the vocabulary has pieces, at most
    total = sum(uses.values())
    if not total:
        return weights
    return {p: math.log((1 - KEPT_PRIOR) * uses.get(p, 0.0) / total + KEPT_PRIOR * math.exp(w)) for p, w in weights.items()}


def _packed(rows: DataFrame) -> DataFrame:
    """The words' scores for the batches that hold them; a task sends those for one batch together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def made() -> pa.RecordBatch:
            of, *rest = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(of, kind="stable")
            of, n = np.unique(of, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(of), *(_as_bytes(x[order], n) for x in rest)], names=["of", "places", "counts", "models"])

        for batch in batches:
            kept.append([batch.column(c).to_numpy() for c in ("batch", "place", "c", "model")])
            size += batch.num_rows
            if size >= TOGETHER:
                yield made()
                kept, size = [], 0
        if size:
            yield made()

    return rows.select("batch", "place", "c", "model").mapInArrow(run, "of bigint, places binary, counts binary, models binary")


def score_texts(df: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every row of ``df``: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``base_score`` is the log10 probability under smoothed word counts, ``score``
    that under the lattice model.  ``path`` is a vocabulary file that the driver can
    read.  A null text is an empty one, of one token, its end.  Null ids are
    held out; repeated rows are scored and learned from as often as they stand.
    An empty table gives an empty result; where all documents are held out, words
    are spelled with probability 1/2 and texts end with 1/2.
    """
    spark = df.sparkSession
    arrow_ready(spark)
    scratch = Scratch(spark, "lattice")
    batches = scratch.write(_batches(df, id_, text), "batches")
    stretches = batches.filter("at is not null").select("batch", "at", F.posexplode(F.arrays_zip("words", "trained")).alias("k", "w"))
    listed = stretches.select("batch", (F.col("at") + F.col("k")).alias("place"), F.col("w.words").alias("word"), F.col("w.trained").alias("trained"))
    counted = listed.groupBy("word").agg(F.sum("trained").alias("c"))
    words = scratch.write(counted, "words")
    trained, distinct, once, twice = words.agg(
        *[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("c"), *[F.when(test, 1).otherwise(0) for test in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)])]
    ).first()
    weights = _estimate(words.filter("c > 0"), read_pieces(path))
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.1
    spelled = discount * distinct / trained if trained else 0.5
    below = math.log10(trained + 0.1 * (distinct + 1))

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        for part in _side_by_side(parts):
            c = part.column("c").to_numpy()
            words = part.column("word").to_pylist()
            end = np.fromiter((w == END for w in words), bool, len(words))
            lattices = lattice.log_probabilities(words)
            spell = np.where(end, 0.0, np.exp(np.maximum(lattices, -690.0)))
            # very long words: the log of the sum is that of the lattice alone
            logs = np.where(~end & (spell < 1e-280), lattices, 0.0)
            whole = np.maximum(c - discount, 0) / trained if trained else np.where(end, 0.5, 0.0)
            with np.errstate(divide="ignore"):
                model = np.log10(whole + spelled * spell)
            model = np.where((logs < 0) & (whole == 0), (logs + math.log(spelled)) / math.log(10), model)
            # an end that no training text has
            model = np.where(np.isneginf(model), -below - 1.0, model)
            yield pa.RecordBatch.from_arrays([part.column("word").combine_chunks(), pa.array(c), pa.array(model)], names=["word", "c", "model"])

    scores = words.mapInArrow(scored, "word binary, c bigint, model double")
    back = _packed(listed.drop("trained").join(scores, "word"))
    schema = T.StructType(
        [
            T.StructField(id_, df.schema[id_].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
        ]
    )

    def joined(documents: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(_as_numbers(found.column("places"), np.int32))
        c, model = _as_numbers(found.column("counts"), np.int64)[order], _as_numbers(found.column("models"), np.float64)[order]
        known, base = c > 0, np.log10(c + 0.1) - below
        parts = []
        for part in documents.to_batches():
            places, counts = (_as_numbers(part.column(k), np.int32) for k in ("places", "counts"))
            ends = np.cumsum(pc.binary_length(part.column("places")).to_numpy() // places.itemsize)
            begins, counts = np.concatenate([[0], ends[:-1]]), counts.astype(np.float64)
            sums = [np.add.reduceat(counts * values[places], begins) for values in (known, base, model)]
            columns = [*(part.column(k) for k in ("id", "held_out", "tokens")), pa.array(sums[0].astype(np.int64)), pa.array(np.full(part.num_rows, trained, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            parts.append(pa.RecordBatch.from_arrays(columns, names=schema.names))
        return pa.Table.from_batches(parts)

    documents = batches.filter("at is null").select("batch", "id", "held_out", "tokens", "places", "counts")
    result = documents.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(joined, schema)
    return scratch.result(result)

"""A quality classifier: kernel ridge regression by random Fourier features, calibrated by isotonic regression.

Every document is described by statistics of its whole text.  Cosines of random
projections of the standardised statistics approximate a Gaussian kernel.  The
normal equations of ridge regression on them are sums over documents: each
partition adds up its own, Spark adds the partitions' blocks, and the driver
solves one system whose size is the number of features.  The sums are kept for
two halves of the labelled rows, so each half is scored by what the other has
taught; those scores, counted in bins, give the monotone map to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafpress.llm.common import Scratch, slices, arrow_ready

#: Random features, width of the kernel (times the root of the number of statistics), ridge.
FEATURES = 256
WIDTH = 0.8
RIDGE = 1e-3
#: Rows of the normal equations in one shuffled block, and bins of scores from -0.5 to 1.5.
BLOCK = 16
BINS = 2000
#: A standardised statistic ends at so many deviations.
FAR = 6.0

STATISTICS = (
    "bytes", "words", "word_length", "long_words", "distinct_words", "commonest_word", "line_length", "repeated_lines",
    "letters", "capitals", "digits", "stops", "symbols", "commonest_symbol", "beyond_ascii", "breaks",
    "words_without_letter", "words_ending_in_symbol", "capital_words", "word_entropy",
)


def held_out(id_: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 3 == 1


def _byte_kinds() -> np.ndarray:
    """One column for each kind of byte."""
    kinds = np.zeros((256, 7), np.float64)
    for b in range(128):
        c = chr(b)
        kinds[b, 0] = c.isalpha()
        kinds[b, 1] = c.isupper()
        kinds[b, 2] = c.isdigit()
        kinds[b, 3] = c in ".,;:?'\"-()"
        kinds[b, 4] = c.isprintable() and not c.isalnum() and c not in " .,;:?'\"-()"
    kinds[128:, 5] = 1
    kinds[0x0A, 6] = 1
    return kinds


_KINDS = _byte_kinds()
_IS_SYMBOL = _KINDS[:, 4] > 0
_SYMBOLS = bytes(np.flatnonzero(_IS_SYMBOL).tolist())
_LETTERS = np.flatnonzero((_KINDS[:, 0] > 0) | (_KINDS[:, 5] > 0))


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; all zero for an empty one."""
    from collections import Counter

    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters, capitals, digits, stops, symbols, beyond, breaks = (counts @ _KINDS / len(data)).tolist()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    shares = np.fromiter(seen.values(), np.float64, len(seen)) / n
    lines = [line for line in data.split(b"\n") if line]
    with_letter = sum(1 for w in seen if not w.isascii() or w.upper() != w.lower())
    ending = sum(c for w, c in seen.items() if w[-1] in _SYMBOLS)
    upper = sum(c for w, c in seen.items() if w.isupper() and len(w) > 1)
    return [
        np.log1p(len(data)), np.log1p(n), lengths.mean(), float((lengths > 15).mean()), len(seen) / n, shares.max(),
        np.log1p(len(data) / len(lines)), 1 - len(set(lines)) / len(lines),
        letters, capitals, digits, stops, symbols, counts[_IS_SYMBOL].max() / len(data), beyond, breaks,
        1 - with_letter / len(seen), ending / n, upper / n, float(-(shares * np.log(shares)).sum() / np.log(n + 1)),
    ]


@dataclass(frozen=True)
class Model:
    """What scoring needs: bounded by the number of features, whatever the data."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    probability: np.ndarray
    seed: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = features(rows, self.mean, self.deviation, self.seed) @ self.weights
        return np.clip(np.interp(raw, self.raw, self.probability), 0.0, 1.0)


def features(rows: np.ndarray, mean: np.ndarray, deviation: np.ndarray, seed: int) -> np.ndarray:
    """Random Fourier features of the statistics, and a constant."""
    rng = np.random.default_rng(seed)
    d = rows.shape[1]
    directions = rng.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d))
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((rows - mean) / deviation, -FAR, FAR)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), np.ones((len(rows), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and ``stats``, the statistics of each whole text (null: as an empty one)."""
    arrow_ready(df.sparkSession)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("stats", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = [statistics(t or "") for t in part.column("_text").to_pylist()]
            columns = [*(part.column(i) for i in range(len(keep))), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "stats"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def _sums(train: DataFrame, mean: np.ndarray, deviation: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations of both halves: (2, n, n) and (2, n)."""
    n = FEATURES + 1
    schema = "half int, block int, sums binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n, n + 1))
        for batch in batches:
            x = features(_matrix(batch.column("stats")), mean, deviation, seed)
            y, half = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "half"))
            for h in (0, 1):
                at = half == h
                total[h] += x[at].T @ np.hstack([x[at], y[at, None]])
        rows = [(h, b, total[h, b * BLOCK : (b + 1) * BLOCK].tobytes()) for h in (0, 1) for b in range(-(-n // BLOCK))]
        yield pa.RecordBatch.from_pylist([dict(zip(("half", "block", "sums"), r)) for r in rows], pa.schema([("half", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())]))

    def add(key, rows):
        import pandas as pd

        total = sum(np.frombuffer(s) for s in rows["sums"])
        return pd.DataFrame({"half": [key[0]], "block": [key[1]], "sums": [total.tobytes()]})

    parts = train.select("stats", "label", "half").mapInArrow(partial, schema)
    out = np.zeros((2, n, n + 1))
    for half, block, sums in parts.groupBy("half", "block").applyInPandas(add, schema).collect():  # 2 * n / BLOCK rows
        out[half, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(sums).reshape(-1, n + 1)
    return out[:, :, :n], out[:, :, n]


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    rows = max(gram[-1, -1], 1.0)
    ridge = RIDGE * rows * np.eye(len(gram)) / 10 + 1e-2 * np.eye(len(gram))
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(gram + ridge, right)


def isotonic(at: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: from sums of labels and rows at rising scores, points of a rising map."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at, labels, rows):
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # half a row of either label keeps the ends off 0 and 1
    return np.array([x / n for x, _, n in blocks]), np.array([(y + 0.5) / (n + 1) for _, y, n in blocks])


def fit(stats: DataFrame, labels: DataFrame, id_: str = "doc_id", label: str = "quality", seed: int = 7) -> Model:
    """Learn from the labelled rows of ``stats`` (id and ``stats``) that are not held out.

    All of them are used.  Null labels and ids teach nothing; a document with
    several labels has their mean.  Without any label every score is 0.5; with
    one kind of label only, scores go to that one.
    """
    d = len(STATISTICS)
    own = labels.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{label}`").cast("double").alias("label")).dropna()
    own = own.filter(~held_out(F.col("id"))).groupBy("id").agg(F.avg("label").alias("label"))
    train = stats.select(F.col(f"`{id_}`").alias("id"), "stats").join(own, "id")
    half = F.pmod(F.crc32(F.concat(F.lit("half"), F.col("id").cast("string"))), F.lit(2)).cast("int")
    train = train.select("stats", "label", half.alias("half")).checkpoint(eager=True)
    moments = stats.agg(
        *[F.avg(F.col("stats")[i]) for i in range(d)], *[F.stddev_pop(F.col("stats")[i]) for i in range(d)]
    ).first()
    moments = np.array([m or 0.0 for m in moments])
    mean, deviation = moments[:d], np.where(moments[d:] > 1e-12, moments[d:], 1.0)
    gram, right = _sums(train, mean, deviation, seed)
    if not gram[:, -1, -1].sum():
        return Model(mean, deviation, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]), seed)
    other = [_solve(gram[1 - h], right[1 - h]) for h in (0, 1)]

    def out_of_half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(_matrix(batch.column("stats")), mean, deviation, seed)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            raw = np.where(half == 0, x @ other[0], x @ other[1])
            bins = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), batch.column("label")], names=["bin", "raw", "label"])

    scored = train.mapInArrow(out_of_half, "bin int, raw double, label double")
    binned = scored.groupBy("bin").agg(F.avg("raw"), F.sum("label"), F.count(F.lit(1))).orderBy("bin").collect()  # at most BINS rows
    _, at, good, rows = (np.array(c, np.float64) for c in zip(*binned))
    raw, probability = isotonic(at, good, rows)
    return Model(mean, deviation, _solve(gram.sum(0), right.sum(0)), raw, probability, seed)


def score(stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Add ``score`` to rows with ``stats``, which go."""
    schema = T.StructType([*[stats.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch.column("stats"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, "score"])

    return stats.select(*keep, "stats").mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 7) -> DataFrame:
    """Id, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` of every row of ``df``.

    Null and empty texts are scored as texts without words; repeated rows and null
    ids get rows like any other.  Neither the id nor other columns are inputs.
    """
    scratch = Scratch(df.sparkSession, "quality")
    stats = scratch.write(with_statistics(df, text, [id_]), "stats")
    scored = score(stats, fit(stats, labels, id_, label, seed), [id_])
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scratch.result(scored.select(id_, held_out(F.col(id_)).alias("held_out"), "score", predicted.alias("predicted")))


def without_rejects(df: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 7) -> DataFrame:
    """The rows of ``df`` that the classifier takes for label 1, with all their columns; texts are not shuffled."""
    scratch = Scratch(df.sparkSession, "quality")
    model = fit(scratch.write(with_statistics(df, text, [id_]), "stats"), labels, id_, label, seed)
    scratch.drop()
    schema = df.schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"c{i}" for i in range(len(schema))]
        for part in slices(batches, names[at]):
            rows = np.array([statistics(t or "") for t in part.column(at).to_pylist()])
            yield part.filter(pa.array(model.score(rows) >= 0.5)).rename_columns(schema.names)

    return df.toDF(*[f"c{i}" for i in range(len(schema))]).mapInArrow(run, schema)


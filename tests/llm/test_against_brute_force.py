"""Operators beside plain versions of themselves, on random texts and vectors."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, duck
from leafpress.llm import bpe, caps, lattice, quality, scan, sharding, simhash, substrings, token_counts, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["op2_source_mix", "op3_spherical_caps", "op9_recompression", "op10_segment_search", "op11_prefix_doubling", "op12_filter_audit", "op13_octopus_manifest"])
def test_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "aZé中 1²½'ʼs t're ll\n\t\r 　​'dve.!?$_́😀\x1c\x85 ΣİK"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "'s's''s'", " " * 500 + "x", "ab" * 700]


def test_encode_as_the_library():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(bpe.read_ranks(f.read()))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = odd_texts(4000)
    ids, at = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == "".join(texts).encode()


@pytest.mark.parametrize("states", [50, 60_000])
def test_counts_as_the_library(states, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "MOST_STATES", states)
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        counter = token_counts.Counter(f.read())
    texts = [*odd_texts(3000), "<|endoftext|> x<|startoftext|>y", "e<|endoftext|>́", "ΑΣ ΑΣΑ"]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want


def test_scan_is_the_automaton():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 4, (4, 5))
    table[:, :3] = table[0, :3]  # few maps
    machine = scan.Automaton(table, 1)
    symbols = rng.integers(0, 5, 5000).astype(np.uint8)
    state, want = 1, []
    for s in symbols:
        want.append(state)
        state = table[state, s]
    assert machine.states_before(symbols).tolist() == want


def test_forest_spans_what_is_near():
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:20]:
        for _ in range(12):
            p ^= 1 << rng.randint(0, 63)
            prints.add(p)
    x = np.array(sorted(prints), np.uint64)
    links = simhash.forest(x, 4)
    groups = {int(v): int(v) for v in x}

    def top(v):
        while groups[v] != v:
            v = groups[v]
        return v

    for a, b in zip(*links):
        groups[top(int(a))] = top(int(b))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    reached = near.copy()
    while not np.array_equal(more := reached @ near, reached):
        reached = more
    tops = np.array([top(int(v)) for v in x], np.uint64)
    assert np.array_equal(tops[:, None] == tops[None, :], reached)
    assert len(links[0]) < len(x)


@pytest.mark.parametrize("bits", [0, 4, 9, 16, 31])
def test_near_prints_share_a_shard(spark, bits):

    rng = random.Random(bits)
    prints = []
    for _ in range(30):
        p = rng.getrandbits(64)
        for _ in range(5):
            prints.append(p)
            for b in rng.sample(range(64), bits):
                p ^= 1 << b
    x = np.unique(np.array(prints, np.uint64))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "print bigint")
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    meet = np.eye(len(x), dtype=bool)
    for r in simhash.shards(df, bits).groupBy("tree", "leaf", "shell").agg(F.collect_set("print").alias("own")).collect():
        own = [at[v] for v in r.own]
        meet[np.ix_(own, own)] = True
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    assert meet[near].all()


def test_prints_and_components(spark):
    import xxhash

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints = {}
    for i, text in rows:
        words = WORD.findall((text or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    component = {i: i for i in prints}
    for _ in prints:
        new = {i: min(component[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == component:
            break
        component = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op1_vantage_prints"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", component[i]) for i, p in prints.items()}


def brute_repeats(texts, window):
    words = {i: (t or "").split() for i, t in texts}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for s in range(len(own) - window + 1):
            if first[tuple(own[s : s + window])] < i:
                gone.update(range(s, s + window))
        left = [w for k, w in enumerate(own) if k not in gone]
        out[i] = (len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [3, 24, 50])
def test_repeats(spark, window):
    rng = random.Random(window)
    passages = [[rng.choice("ab") for _ in range(rng.randint(window - 1, 3 * window))] for _ in range(6)]
    passages += [["na"] * rng.randint(window, 4 * window) for _ in range(2)] + [["x", "y"] * window]
    texts = []
    for i in range(80):
        own = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            own += p[a : a + rng.randint(0, len(p))] + [f"u{rng.randint(0, 9)}" for _ in range(rng.randint(0, window))]
        texts.append((i, rng.choice([" ", "\n "]).join(own)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.find_repeats(df, window=window).collect()}
    assert got == brute_repeats(texts, window)


def test_lattice_sums_all_segmentations(monkeypatch):
    weights = {b"a": -1.0, b"b": -2.0, b"ab": -1.5, lattice.MARK + b"a": -0.7, lattice.MARK + b"aba": -3.0, lattice.MARK: -0.2}
    own = lattice.Lattice(weights)

    def ways(rest):
        if not rest:
            return [0.0]
        return [w + x for p, w in weights.items() if not p.startswith(lattice.MARK) and rest.startswith(p) for x in ways(rest[len(p) :])]

    word = b"abab"
    every = []
    for p, w in weights.items():
        if p.startswith(lattice.MARK) and word.startswith(p[3:]):
            every += [w + x for x in ways(word[len(p) - 3 :])]
    assert math.isclose(own.log_probability(word), math.log(sum(map(math.exp, every))))
    counts = {}
    own.add_expected(word, counts)
    monkeypatch.setattr(lattice, "SHORT", 0)
    by_logs = {}
    own.add_expected(word, by_logs)
    assert all(math.isclose(counts.get(p, 0), by_logs.get(p, 0), abs_tol=1e-12) for p in weights)
    spelled = sum(n * (len(p) - 3 if p.startswith(lattice.MARK) else len(p)) for p, n in counts.items())
    assert math.isclose(spelled, len(word))


def test_lattice_side_by_side_is_one_by_one(monkeypatch):
    """Short words go through the lattice together, none alone; the results are those of each word's own recursion in logs."""
    own = lattice.Lattice(lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(8)
    words = [b"", *(bytes(rng.choices(b"aehinrst.,", k=rng.randint(1, 16))) for _ in range(300))]
    words += [rng.randbytes(rng.randint(1, 30)) for _ in range(60)] + ["\u65e5\u672c\u8a9e".encode() * 9, b"a" * 24, b"a" * 25, b"a" * 90]
    one = [own.log_probability(w) for w in words]
    assert np.allclose(own.log_probabilities(words), one, rtol=1e-12, atol=0)
    together, counts = own.expected(words), {}
    with monkeypatch.context() as m:
        m.setattr(lattice, "SHORT", -1)
        for w in words:
            own.add_expected(w, counts)
    assert all(math.isclose(together.get(p, 0), n, rel_tol=1e-9, abs_tol=1e-200) for p, n in counts.items())
    assert own.log_probabilities([]).shape == (0,) and own.expected([]) == {}
    monkeypatch.setattr(lattice.Lattice, "log_probability", None)
    monkeypatch.setattr(lattice.Lattice, "forward", None)
    short = [w for w in words if len(w) <= 16]
    assert np.allclose(own.log_probabilities(short), [x for x, w in zip(one, words) if len(w) <= 16], rtol=1e-12, atol=0)
    assert own.expected(short)


def test_lattice_scores_against_a_plain_lattice(spark, monkeypatch):
    """Every column over texts with odd spaces, from plain counts and one recursion in logs for each word."""
    from collections import Counter

    import zlib

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(3)
    some = ["the", "The", "then", "a", "\u00e9t\u00e9", "x\u00a0y", "\x1cz", "\x85", "\x00", "n" * 60]
    texts = [None, "", " \n", "\x0bA\x0c b\r\tA "]
    texts += [rng.choice(["", " "]) + "".join(rng.choice(some) + rng.choice(" \t\n\x0b\x0c\r") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in lattice.score_texts(df, path).collect()}
    tokens = {i: [*WORD.findall((t or "").encode().lower()), b""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v, once, twice = sum(c.values()), len(c), sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.1
    weights, uses = lattice.read_pieces(path), {}
    monkeypatch.setattr(lattice, "SHORT", -1)
    first = lattice.Lattice(weights)
    for w in filter(None, c):
        first.add_expected(w, uses)
    total, kept = sum(uses.values()), lattice.KEPT_PRIOR
    own = lattice.Lattice({p: math.log((1 - kept) * uses.get(p, 0) / total + kept * math.exp(w)) for p, w in weights.items()})

    def log10(w):
        spelled = discount * v / n * math.exp(own.log_probability(w)) if w else 0.0
        return math.log10(max(c[w] - discount, 0) / n + spelled)

    assert got.keys() == tokens.keys()
    for i, words in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(words), sum(c[w] > 0 for w in words), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
        assert math.isclose(got[i].score, sum(map(log10, words)), rel_tol=1e-9)


def test_lattice_rows_hold_no_batch(spark, monkeypatch):
    """Rows hold a stretch of words or one document, words and scores go in many of them; batches, stretches and parts of any size give the same scores."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 4000)}" for _ in range(200)) for _ in range(60)] + [None, "", "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    rows = lattice._batches(df, "doc_id", "text").collect()
    distinct = {w.encode() for t in texts if t for w in t.split()} | {b""}
    assert len(distinct) > 3000 and sorted(w for r in rows for w in r.words or []) == sorted(distinct)
    assert max(len(r.words or []) for r in rows) <= 1024
    assert sum(r.places is not None for r in rows) == len(texts)
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = {r.doc_id: r for r in lattice.score_texts(df, path).collect()}
    for name, value in (("BATCH_BYTES", 5000), ("STRETCH", 7), ("TOGETHER", 100)):
        monkeypatch.setattr(lattice, name, value)
    assert len({r.batch for r in lattice._batches(df, "doc_id", "text").collect()}) == 1  # a slice of texts is in one batch
    monkeypatch.setattr(lattice, "slices", lambda batches, text: (b.slice(i, 5) for b in batches for i in range(0, b.num_rows, 5)))
    rows = lattice._batches(df, "doc_id", "text").collect()
    assert len({r.batch for r in rows}) > 5 and max(len(r.words or []) for r in rows) == 7
    parts = {r.doc_id: r for r in lattice.score_texts(df, path).collect()}
    assert whole.keys() == parts.keys() == set(range(len(texts)))
    for i, r in whole.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (parts[i].held_out, parts[i].n_tokens, parts[i].n_known, parts[i].train_tokens)
        assert math.isclose(r.base_score, parts[i].base_score, rel_tol=1e-9) and math.isclose(r.score, parts[i].score, rel_tol=1e-9)


def test_lattice_scores_against_counts(spark):
    from collections import Counter

    import zlib

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: [*WORD.findall(r.text.encode().lower()), b""] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in entry.queries()["op5_lattice_scores"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, own in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9)
    known = [(got[i].score, got[i].base_score) for i in tokens]
    assert np.corrcoef(np.array(known).T)[0, 1] > 0.99


def test_quality_on_held_out_rows(spark):
    got = entry.queries()["op4_quality"](spark, "/root/testdata/sf0.01").filter("held_out")
    own = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in own]) > 0.95


def test_isotonic_rises():
    at, p = quality.isotonic(np.arange(6.0), np.array([0.0, 3, 1, 2, 5, 4]), np.full(6, 5.0))
    assert (np.diff(p) >= 0).all() and (np.diff(at) > 0).all()


def near_pairs(dimension, n, cosine, seed=4):
    rng = np.random.default_rng([seed, dimension])
    x = rng.standard_normal((n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("dimension", [12, 16, 33, 64, 256, 1024])
@pytest.mark.parametrize("words", [128, 256])
def test_recall_of_caps(dimension, words):
    """Pairs at the least similarity and above share a cap: of 1,000 pairs one may be missed at most."""
    code = caps.ProductCode.of(dimension, 7, words)
    for cosine in (0.98, 0.99, 0.999):
        x, y = near_pairs(dimension, 1000 if dimension < 1000 else 300, cosine)
        missed = sum(not set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(code.decode(x), code.decode(y)))
        assert missed <= 1


@pytest.mark.parametrize("dimension", [1, 2, 3, 4, 5, 8, 11, 48])
def test_cells_lose_nothing(dimension):
    for least, cosine in ((0.98, 0.98), (0.98, 0.999), (0.8, 0.8), (1.0, 1.0)):
        x, y = near_pairs(dimension, 1000, cosine) if dimension > 1 else (np.ones((5, 1)), np.ones((5, 1)))
        for p, q in ((x, y), (y, x)):
            own, reached = caps.cells(p, least, 7)[0], caps.cells(q, least, 7)[1]
            assert all(i in row for i, row in zip(own, reached))


@pytest.mark.parametrize("dimension, exact", [(2, False), (3, False), (4, False), (7, False), (16, False), (16, True)])
def test_near_vectors_in_any_dimension(spark, dimension, exact):
    x, y = near_pairs(dimension, 150, 0.985)
    rows = np.concatenate([x, y]) * np.random.default_rng(1).uniform(0.1, 9, (300, 1))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, r.tolist(), i % 150 % 2) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>, label int")
    label = np.arange(300) % 150 % 2
    near &= label[:, None] == label[None, :]
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_vectors(df, exact=exact).collect()}
    top = np.arange(300)
    while True:
        new = np.minimum(top, np.where(near, top[None, :], 300).min(1))
        if (new == top).all():
            break
        top = new
    assert got == {i: (int(near[i].sum()), int(top[i])) for i in range(300)}


def test_search_prunes_nothing_that_counts():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.standard_normal((900, 40)))
    rows[100:130] = rows[0]
    ids = rng.permutation(900)
    queries = rows[:20]
    for i, at, score in topk.best(queries, rows, np.arange(20), ids, 5):
        every = rows @ queries[i]
        want = sorted((-s, ids[j], j) for j, s in enumerate(every) if j != i)[:5]
        assert [j for _, _, j in want] == at.tolist() and [-s for s, _, _ in want] == score.tolist()


def plain_ring(rows, cell_of, node_cells, shards, cells):
    """Shard and slot of each row by a walk over the ring: homes up to their bounds first, then the overflow clockwise."""
    ring = {}
    for s, c in node_cells:
        ring[c] = min(s, ring.get(c, s))
    arcs = sorted(ring)
    own = lambda c: next((i for i, a in enumerate(arcs) if a >= c), 0)
    bound = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    held, over = [[] for _ in range(shards)], [[] for _ in arcs]
    for row in sorted(rows, key=lambda r: (cell_of[r[0]], r)):
        arc = own(cell_of[row[0]])
        shard = ring[arcs[arc]]
        (held[shard] if len(held[shard]) < bound[shard] else over[arc]).append(row)
    for arc, left in enumerate(over):
        way = [ring[arcs[(arc + i) % len(arcs)]] for i in range(len(arcs))]
        way += sorted(set(range(shards)) - set(way))
        for shard in dict.fromkeys(way):
            free = bound[shard] - len(held[shard])
            held[shard] += left[:free]
            left = left[free:]
        assert not left
    return sorted((*row, shard, slot) for shard, rows in enumerate(held) for slot, row in enumerate(rows))


@pytest.mark.parametrize("shards, vnodes, cells, distinct", [(24, 64, 1 << 14, 3000), (5, 2, 64, 40), (3, 4, 12, 3), (4, 1, 4, 1000), (1, 1, 8, 20)])
def test_ring_as_a_plain_walk(spark, shards, vnodes, cells, distinct):
    """Rows of the query's kind, with repeated keys and rows."""
    rng = random.Random(shards)
    rows = [(min(rng.randrange(distinct), rng.randrange(distinct)), rng.randrange(3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint")
    keys = df.select("doc_id", sharding._cell(cells, 7, F.lit("key"), F.col("doc_id")).alias("c")).distinct().collect()
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("s"), (F.col("id") / shards).cast("int").alias("n"))
    node_cells = [tuple(r) for r in nodes.select("s", sharding._cell(cells, 7, F.lit("node"), F.col("s"), F.col("n"))).collect()]
    got = sharding.ring_shards(df, "doc_id", shards, vnodes=vnodes, cells=cells).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(tuple(r) for r in got) == plain_ring(rows, {r.doc_id: r.c for r in keys}, node_cells, shards, cells)


def test_consistent_ring_query_as_a_plain_walk(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs]
    keys = spark.createDataFrame([(r[0],) for r in rows], "doc_id bigint").select("doc_id", sharding._cell(1 << 14, 7, F.lit("key"), F.col("doc_id")).alias("c")).collect()
    nodes = spark.range(24 * 64).select((F.col("id") % 24).cast("int").alias("s"), (F.col("id") / 24).cast("int").alias("n"))
    node_cells = [tuple(r) for r in nodes.select("s", sharding._cell(1 << 14, 7, F.lit("node"), F.col("s"), F.col("n"))).collect()]
    got = entry.queries()["op6_consistent_ring"](spark, SF).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(tuple(r) for r in got) == plain_ring(rows, {r.doc_id: r.c for r in keys}, node_cells, 24, 1 << 14)

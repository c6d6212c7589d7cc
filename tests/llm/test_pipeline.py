"""Stages of the corpus pipeline beside plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def one_of_each(rows):
    """The smallest ids of the groups that links of similarity 0.8 or more reach."""
    sets = {i: shingle_set(text or "") for i, text in rows}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and group[i] != group[j] and similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i for i, g in group.items() if i == g}


def test_near_copies_from_similarity_08_on(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, wanted = [], {s: 0 for s in (80, 85, 90, 95)}
    for n in (60, 200, 600) * 40:
        base = [rng.choice(vocabulary) for _ in range(n)]
        copy = list(base)
        for at in rng.sample(range(n), max(1, int(n * rng.uniform(0.004, 0.035)))):
            copy[at] = rng.choice(vocabulary)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " \n".join(copy).upper())]
        s = similarity(*(shingle_set(t) for _, t in rows[-2:]))
        if s >= 0.8:
            wanted[min(95, int(s * 20) * 5)] += 1
    assert min(wanted.values()) > 5
    assert len(one_of_each(rows)) < len(rows) - sum(wanted.values()) + 1
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()} == one_of_each(rows)


def test_a_group_in_blocks(spark, monkeypatch):
    from leafpress.llm import jaccard

    rng = random.Random(3)
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        for at in rng.sample(range(120), 2):
            base[at] = f"x{rng.random()}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()} == one_of_each(rows)


def test_near_prints_propose_copies(spark, monkeypatch):
    from leafpress.llm import jaccard, simhash

    rng = random.Random(5)
    rows, near = [], []
    for i in range(0, 120, 2):
        base = [f"w{rng.randrange(5000)}" for _ in range(600)]
        copy = list(base)
        copy[rng.randrange(600)] = "other"
        rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
        prints = [simhash.fingerprint(text, corpus_pipeline.WORDS) for _, text in rows[-2:]]
        assert prints == [jaccard.majority(jaccard.hashes(text, corpus_pipeline.WORDS)) for _, text in rows[-2:]]
        near += [i + 1] * ((prints[0] ^ prints[1]).bit_count() <= corpus_pipeline.BITS)
    assert 20 < len(near) < 60
    rows += [(200, ""), (201, None), (202, "a a a a a a a"), (203, "a a a a a a a a")]
    monkeypatch.setattr(jaccard, "_band_links", lambda sets: sets.select("key", "key").limit(0).toDF("a", "b"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()}
    assert kept == {i for i, _ in rows} - set(near) - {201, 203}


PIECE = re.compile(r"[^ \t-\r]+[ \t-\r]*")


def without_passages(texts, window=50):
    words = {i: PIECE.findall(t) for i, t in texts.items()}
    plain = {i: [p.strip(" \t\n\x0b\x0c\r") for p in own] for i, own in words.items()}
    first, out = {}, {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(plain[i][s : s + window]), i)
    for i, own in words.items():
        gone = {s + k for s in range(len(own) - window + 1) if first[tuple(plain[i][s : s + window])] < i for k in range(window)}
        if not gone:
            out[i] = texts[i]
        elif len(gone) < len(own):
            out[i] = "".join(p for k, p in enumerate(own) if k not in gone)
    return out


def mixed(texts, source, block=32):
    """Ids and texts of the mix, by the statement of ``op2_source_mix``."""
    seeded = lambda x: int(hashlib.md5(f"7|{x}".encode()).hexdigest()[:15], 16)
    words = {i: PIECE.findall(t) for i, t in texts.items()}
    size = Counter()
    for i, own in words.items():
        size[source[i]] += len(own)
    names = sorted(size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, left = 0, sum(weight.values())
    for s in sorted(names, key=lambda s: 2 * size[s] / weight[s]):
        level = (1.5 * sum(size.values()) - full) / left
        if 2 * size[s] > weight[s] * level:
            break
        full, left = full + 2 * size[s], left - weight[s]
    target = {s: min(2.0 * size[s], weight[s] * level) for s in names}
    blocks = {s: math.ceil(size[s] / block) for s in names}
    seats = sorted((-target[s] / (2 * k + 1), p, k) for p, s in enumerate(names) for k in range(math.ceil(target[s] / block) + 40))
    quota = Counter(p for _, p, _ in seats[: round(round(sum(target.values()), 3) / block)])
    out = []
    for p, s in enumerate(names):
        n = blocks[s]
        taken = min(quota[p], 2 * n)
        copies, rest, offset, begins = taken // n, taken % n, seeded(p + 1) % n, 0
        for i in sorted((i for i in texts if source[i] == s), key=lambda i: (seeded(i), i)):
            own = words[i]
            out += [(i, texts[i])] * copies if own else []
            more = [w for k, w in enumerate(own, begins) if ((b := k // block) + 1 + offset) * rest // n > (b + offset) * rest // n]
            out += [(i, "".join(more))] if more else []
            begins += len(own)
    return out


def test_run_as_the_plain_stages(spark):
    import tiktoken

    from leafpress.llm.bpe import read_ranks

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    passed = {r.doc_id for r in entry.queries()["op4_quality"](spark, SF).collect() if r.predicted == 1}
    kept = one_of_each([(i, rows[i].text) for i in passed])
    cut = without_passages({i: rows[i].text for i in kept})
    stand = mixed(cut, {i: rows[i].source for i in cut})
    assert len(rows) > len(passed) > len(kept) and sum(map(len, cut.values())) < sum(len(rows[i].text) for i in kept)
    with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as f:
        codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    want = Counter()
    for i, text in stand:
        ids, offsets, at = codec.encode_ordinary(text), [], 0
        for t in ids:
            offsets.append(at)
            at += len(codec.decode_single_token_bytes(t))
        sha = hashlib.sha256(text.encode()).hexdigest()
        want[i, rows[i].source, len(text), tuple(ids), tuple(offsets), len(ids), sha, sha] += 1
    got = Counter(
        (r.doc_id, r.source, r.n_chars, tuple(r.token_ids), tuple(r.token_offsets), r.n_tokens, r.text_sha256, r.decoded_sha256)
        for r in corpus_pipeline.run(spark, SF).collect()
    )
    assert got == want

"""Repeated strings (11), filter audit (12) and manifest (13) beside plain versions, and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafpress.llm import audit, manifest, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(texts, n):
    whole = [(t or "").encode() for t in texts]
    count = Counter(b[s : s + n] for b in whole for s in range(len(b) - n + 1))
    out = []
    for b in whole:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if count[b[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n):
    rng = random.Random(seed)

    def some(k, letters="abcé "):
        return "".join(rng.choice(letters) for _ in range(k))

    base = [some(rng.randint(0, 150)) for _ in range(15)]
    texts = []
    for _ in range(60):
        t = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(base)
            x = rng.randint(0, len(b))
            t += b[x : x + rng.randint(10, 80)] + some(rng.randint(0, 9))
        texts.append(t)
    return texts + [None, "", "a" * 300, "a" * n, "ab" * 100, texts[3], texts[3], texts[5]] + ["common passage that is quite long, surely " * 2 + str(i) for i in range(40)]


@pytest.mark.parametrize("seed, length, chunk", [(1, 16, 7), (2, 40, 60), (3, 8, 100_000)])
def test_repeats_as_plain(spark, monkeypatch, seed, length, chunk):
    """Small chunks make groups go on from task to task, and larger ones than a chunk."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    texts = passages(seed, length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.find_repeats(df, length=length).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts, length)


def test_pieces_of_a_long_text_give_the_anchors_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, 3, 5000), np.zeros(900), np.tile(rng.integers(0, 9, 7), 90)]).astype(np.uint8)
    whole = suffixes.anchors_of(data, np.array([len(data)]), 40)
    monkeypatch.setattr(suffixes, "PIECE", 333)
    for a, b in zip(whole, suffixes._long_anchors(data, 40)):
        assert a.tolist() == b.tolist()
    # every string has the anchor of least hash, at the same offset wherever it stands
    place, first, last, hashes = whole
    assert sum(last - first + 1) == len(data) - 39 and (place >= last).all() and (place <= first + 30).all()


def test_repeats_on_edges(spark):
    rows = [(1, "x" * 250, "k"), (1, "x" * 250, "k"), (None, "y" * 199, None), (None, None, "k"), (2, "", "k"), (3, "é" * 99, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.find_repeats(df).collect())
    assert got == [(0, 0, 0, 0), (0, 199, 0, 0), (1, 250, 250, 1), (1, 250, 250, 1), (2, 0, 0, 0), (3, 198, 0, 0)]
    assert suffixes.find_repeats(df.limit(0)).count() == 0
    for length in (6, 10, 4096):
        with pytest.raises(ValueError):
            suffixes.find_repeats(df, length=length)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "aZé中 1²½'ʼs\n\t\r\x0b\x0c　​#$%&*|_́😀\x1c\x85 Σİ K"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return texts + ["", " ", "a" * 3000 + " " + "a" * 3000 + " " + "a" * 2999 + "b", "ab " * 700, "x" * 256 + " " + "x" * 257]


def test_transducer_as_plain():
    texts = odd_texts(2000)
    raw = [t.encode() for t in texts]
    counts = audit.passed(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        want = (len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t)))
        assert tuple(int(counts[k][i]) for k in ("words", "distinct", "capitals", "points", "symbols")) == want, t


def test_words_of_one_slot_are_told_apart(monkeypatch):
    """All words have one hash: the bytes decide."""
    monkeypatch.setattr(audit, "_mix", lambda x: x * np.uint64(0))
    words = [f"word{i % 50:09d}".encode() for i in range(300)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    assert audit.passed(data, np.array([len(data)]))["distinct"].tolist() == [50]


def plain_audit(rows, good, toxic):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        own = "A" if len(words) < 200 else ""
        own += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        own += "C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else ""
        own += "D" if re.search(r"[#$%&*|]", t) else ""
        own += "E" if i is not None and i > first[t] else ""
        fails.append((part or "", own, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine, shapley = [f for f in fails if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                kept = [f for f in left if x not in f[1]]
                out[part, "".join(order), k] = [
                    len(kept), len(gone), sum(x in f[1] for f in mine) - len(gone), sum(f[1] == x for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone), x,
                ]
                shapley[x] += len(gone)
                left = kept
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]] if isinstance(row[-1], str) else row[-1]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_as_plain(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(250))
    pool = ["", None, "SHOUT " * 10, "a # b", long, long + " |", "na " * 300, long.upper(), "NA # " * 300]
    rows = [(rng.choice([*range(30), None]), rng.choice(pool), rng.choice(["s", "t", None, ""])) for _ in range(120)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, source string, part string, fails int").repartition(4)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(df, labels).collect()}
    assert got == plain_audit(rows, {1, 2}, {1, 3})
    assert audit.audit(df.limit(0), labels).count() == 0
    assert audit.audit(df, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    return [row[(i >> k) ^ 1] for k, row in enumerate(levels[:-1]) if (i >> k) ^ 1 < len(row)]


def climb(levels, i, leaf):
    for k, row in enumerate(levels[:-1]):
        other = (i >> k) ^ 1
        leaf = h(*([leaf] if other >= len(row) else [row[other], leaf] if (i >> k) & 1 else [leaf, row[other]]))
    return leaf


def plain_manifest(rows):
    def written(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = {}
    for r in rows:
        i, source, lang, n, text = r
        leaf = h(*map(written, r))
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        changed = h(*map(written, (i, source, lang, n + 1 if hit and n is not None else n, text)))
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, changed, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[2] for x in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, changed, own) in enumerate(groups[g]):
            folded = climb(top, k, climb(trees[g], i, changed))
            out.append((own, leaf, trees[g][-1][0], top[-1][0], h(*path(trees[g], i), *path(top, k)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("levels, n", [(12, 60), (2, 150), (1, 45)])
def test_manifest_as_plain(spark, monkeypatch, levels, n):
    """Small leaf partitions make trees of many rounds, over the languages too."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "SPAN", 1 << levels)
    rng = random.Random(n)
    langs = [None, "", "en", "en", "en", "é", "zz", *(f"l{i}" for i in range(9))]
    rows = [(rng.choice([i, i, i, None, 5]), rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([0, 7, None]), rng.choice(["text", "", None, "é|:"])) for i in range(n)]
    kinds = "doc_id long, source string, lang string, n_chars long, text string, k string, node string, i int"
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], kinds).repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = manifest.manifest(df, changed=hit, change=("n_chars", F.col("n_chars") + 1)).collect()
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(plain_manifest(rows), key=order)
    assert not all(r.verified for r in got)
    assert all(r.verified for r in manifest.manifest(df.limit(40)).collect())


def test_manifest_on_edges(spark):
    kinds = "doc_id long, source string, lang string, n_chars long, text string"
    one = manifest.manifest(spark.createDataFrame([(1, None, None, None, None)], kinds)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == h("1:1----") and one.proof_sha256 == h() and one.verified
    assert manifest.manifest(spark.createDataFrame([], kinds)).count() == 0


def test_missing_nodes_are_the_fewest_that_do():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 8, 21):
        for _ in range(20):
            leaves = set(rng.sample(range(n), rng.randint(1, n)))
            asked = set(manifest.missing(leaves, n))
            known = {(0, i) for i in leaves} | asked
            # a node follows from its children; the root follows, and without any asked one it does not
            def follows(known):
                known = set(known)
                for level in range(manifest.height(n)):
                    size = -(-n // (1 << level))
                    for i in range(-(-size // 2)):
                        if all((level, j) in known for j in (2 * i, 2 * i + 1) if j < size):
                            known.add((level + 1, i))
                return (manifest.height(n), 0) in known

            assert follows(known)
            assert all(not follows(known - {a}) for a in asked)

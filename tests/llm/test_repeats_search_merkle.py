"""Repeated passages, ranked search and the manifest against brute force on odd texts, ties, copies and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import lexical, merkle, recompression
from lectern.llm.util import hashed_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __n string, rep string, whole string"


def rows(texts, ids=None, langs=None):
    ids, langs = ids or range(len(texts)), langs or ["en"] * len(texts)
    return [(i, t, g, "s", None if t is None else len(t), "x", "y", "z") for i, t, g in zip(ids, texts, langs)]


def passages(seed, n=60, words=("a", "b", "Be", "be", "é", "d")):
    """Texts of few different words, with long runs, shared passages, copies, and words that differ in case alone."""
    r = random.Random(seed)
    pool = [" ".join(r.choices(words, k=r.randrange(5, 40))) for _ in range(6)] + ["a " * 40, "b " * 17 + "d", "a b " * 20]
    texts = [" \n".join(r.choice(pool) if r.random() < 0.5 else " ".join(r.choices([*words, *map(str, range(40))], k=r.randrange(1, 30))) for _ in range(r.randrange(1, 6))) for _ in range(n)]
    return texts + [texts[0], texts[1] + " ", None, "", "a", "a " * 12, "a " * 13, "a " * 14, "A " * 13]


def kept(docs):
    """(doc_id, n_words, n_removed, kept) by the rule, over (doc_id, text)."""
    split = [(i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for i, t in docs]
    first = {}
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - 12) for j in range(13) if i is not None and first[tuple(w[k : k + 13])] < i}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, full, block, bits", [(1, 1 << 21, 1 << 20, 1 << 24), (2, 0, 1 << 20, 64), (3, 1 << 21, 40, 64), (4, 0, 40, 1 << 24)])
def test_repeats_against_brute_force(spark, monkeypatch, seed, full, block, bits):
    monkeypatch.setattr(recompression, "BITS", bits)  # 64: all bitmaps are full, so nothing is passed over
    monkeypatch.setattr(recompression, "FULL", full)  # 0: shared names are joined
    texts = passages(seed)
    ids = [*range(len(texts) - 4), None, None, 5, 5]
    random.Random(seed).shuffle(texts)
    got = recompression.without_repeats(spark.createDataFrame(rows(texts, ids), DOCS).repartition(5), block=block)  # 40: most texts are taken in parts
    assert sorted(map(tuple, got.collect()), key=str) == kept(list(zip(ids, texts)))


def test_repeats_of_nothing(spark):
    assert recompression.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert recompression.without_repeats(spark.createDataFrame(rows([None, "", "one"]), DOCS)).count() == 3


def test_repeats_of_a_very_long_text(spark):
    r = random.Random(7)
    long = " ".join(str(r.randrange(1 << 30)) for _ in range(300_000))
    part = long.split()[150_000:150_020]
    got = {x.doc_id: x for x in recompression.without_repeats(spark.createDataFrame(rows(["x " + " ".join(part), long]), DOCS)).collect()}
    assert got[1].n_removed == 20 and got[0].n_removed == 0


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
def test_equal_windows_have_equal_high_symbols(rounds):
    """Wherever a window stands, whatever is around it, and whether its runs go on outside."""
    texts = [t or "" for t in passages(11, 80)]
    words, counts = hashed_words(pa.array(texts), codes=recompression.CODES)
    at, names = recompression.high_symbols(words, counts, rounds=rounds)
    assert at.tolist() == [k for k, e in enumerate(np.repeat(np.cumsum(counts), counts)) if k + 13 <= e]
    of = {}
    for k, name in zip(at.tolist(), names.tolist()):
        assert of.setdefault(words[k : k + 13].tobytes(), name) == name
    assert len(set(of.values())) > 50


def terms(text):
    return [x.encode().lower().decode() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k):
    split = [(i, Counter(terms(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n, total, df = len(split), sum(sum(c.values()) for _, c in split), Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        score = []
        for i, c in split:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0 and i is not None:
                score.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(score)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("docs_in, few, exact", [(1024, 4096, 1 << 53), (3, 4, 1 << 53), (2, 1, 0)])
def test_search_against_brute_force(spark, monkeypatch, docs_in, few, exact):
    monkeypatch.setattr(lexical, "EXACT", exact)  # 0: whole numbers instead of doubles
    monkeypatch.setattr(lexical, "ITEMS", 200)  # several blocks
    r = random.Random(5)
    words = ["the", "The", "of", "é", "É", "x1", "rare", "no-one", "a.b", *(f"w{k}" for k in range(60))]
    texts = [" ".join(r.choices(words, k=r.choice([1, 2, 5, 5, 5, 40]))) for _ in range(150)] + [None, "", "...", "the", "the", "the " * 3000]
    ids = [*range(len(texts) - 3), None, 7, 999]
    items = [(k, " ".join(r.choices(words, k=6))) for k in range(12)] + [(3, "the the rare"), (50, None), (51, ""), (52, "unknown"), (53, "the")]
    index = lexical.build(spark.createDataFrame(rows(texts, ids), DOCS).repartition(3), docs_in, few)  # small segments and parts
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(list(zip(ids, texts)), items, 4)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.build(spark.createDataFrame([], DOCS)), items).count() == 0
    index = lexical.build(spark.createDataFrame(rows(["a b", "c"]), DOCS))
    assert lexical.search(index, items.limit(0)).count() == 0 and lexical.search(index, items).count() == 1


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def digest(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes, p):
    """(top, siblings of node p level by level, its place in each run) of a tree."""
    path = []
    while len(nodes) > 1:
        run = p - p % 8
        path.append((nodes[run:p], nodes[p + 1 : run + 8]))
        nodes, p = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)], p // 8
    return nodes[0], path


@pytest.mark.parametrize("levels, sizes", [(4, {"en": 70, None: 9, "de": 1, "é": 8}), (1, {"en": 130, None: 65, "de": 1, "z": 8}), (2, {f"l{k}": 1 for k in range(11)}), (2, {"en": 1})])
def test_manifest_against_brute_force(spark, levels, sizes):
    docs, at = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            docs.append((None if at == 3 else 10 if at == 12 else at, None if at % 7 == 2 else f"Text {at} É" * (at % 5), lang, None if at % 5 == 1 else "s", None if at % 4 == 1 else at, "x", "y", "z"))
            at += 1
    docs.append(docs[-1])  # a repeated row
    trees = {}
    for i, t, g, s, c, *_ in docs:
        low = t.encode().lower().decode() if t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t
        trees.setdefault(g, []).append((i is not None, i or 0, digest(i, s, g, c, t), digest(i, s, g, c, low), i))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        trees[g].sort(key=lambda x: x[:4])
    subroots = [climbed([x[2] for x in trees[g]], 0)[0] for g in order]
    want = []
    for k, g in enumerate(order):
        root, above = climbed(subroots, k)
        for p, (_, _, own, claim, i) in enumerate(trees[g]):
            path = climbed([x[2] for x in trees[g]], p)[1] + above
            for left, right in path:
                claim = sha("".join([*left, claim, *right]))
            want.append((i, own, subroots[k], root, sha("".join(x for a, b in path for x in a + b)), claim, claim == root))
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    got = merkle.manifest(frame, merkle.lowered_claims(), levels=levels)  # 1: superblocks of 8 leaves, so several rounds
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)
    assert all(r.verified for r in merkle.manifest(frame).select(F.col("verified")).distinct().collect())


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0

"""The operators and the pipeline against independent brute force, and the literal cases that once gave wrong results."""

import gc
import hashlib
import itertools
import random
import re
import struct
import time
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import decontam, jaccard, licenses, packing, pii, quality, queries, tokens, util, warc
from lectern.llm.tokens import Encoder
from lectern.llm.util import table

from .test_llm import DOCS, ODD, SF, brute_components, words

ALPHABET = [*"abcXYZ.,'stdvreml019-_!?()\"", *[" "] * 12, *["\n"] * 3, "'s", "'ll", "'T", "<|endoftext|>"]
ALPHABET += [chr(x) for x in (0xE9, 0xC9, 0xDF, 0x130, 0x307, 0x3A3, 0x3C2, 0xFB01, 0x1C5, 0x65E5, 0xD55C, 0x1100, 0x663, 0xB2, 0xBD, 0x2B0, 0x1F600, 0x1E900, 0x1E0D, 0x344, 0x212B, 0xA7DF, 0x10D0, 0x1C90)]
WHITE = [chr(x) for x in (9, 13, 11, 12, 28, 31, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x200B, 0x180E, 0xFEFF, 0)]


@pytest.mark.parametrize("name, lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_the_library(name, lead):
    path = queries.vocabulary(name)
    own, tok, rng = Encoder(path, lead), Tokenizer.from_file(path), random.Random(7)
    texts = []
    for k in range(60_000):
        letters = ALPHABET + WHITE if k % 3 == 0 else ALPHABET
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        t = " ".join(x for x in t.replace("\n", " ").split(" ") if x) if k % 2 else t
        texts.append(t)
    for some in itertools.batched(texts, 1000):
        flat, n = own.ids(pa.array(some))
        for t, ids in zip(some, np.split(flat, np.cumsum(n)[:-1])):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    for t in ("Ali İ. geldi", "a\x1c b", "x\ty\n\xa0", "one\xa0two\n\n\tthree"):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.one(t) == struct.pack(f"<{len(ids)}I", *ids)


def test_packing_against_the_library(spark):
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    docs = table(spark, SF, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, "Ali İ. geldi"), (-2, "a\x1c b"), (-3, None), (-4, "x " * 9000)], "doc_id long, text string"))
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    covered, filled = {}, {}
    for r in packing.pack(docs, queries.vocabulary("word_bpe_49k.json")).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), len(want[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    gapless = lambda parts: all(a + n == b for (a, n), (b, _) in zip([(0, 0), *sorted(parts)], [*sorted(parts), (sum(n for _, n in parts), 0)]))
    assert all(map(gapless, [*covered.values(), *filled.values()])) and {k: sum(n for _, n in v) for k, v in covered.items()} == {k: len(v) for k, v in want.items()}
    assert [sum(n for _, n in filled[k]) for k in sorted(filled)][:-1] == [4096] * (len(filled) - 1)


def test_warc_keeps_every_payload(spark):
    a, b = "<a>" * 500, "<b>" * 500
    rows = [(5, "u", a), (5, "u", b), (9, "u", a), (9, "u", a), (None, "u", a), (None, None, None), (7, "u", b), (7, "u", a)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    chunks = warc.read_archives(spark, warc.write_archives(pages), chunk=400).cache()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    last = {a: 9, b: 7}
    want = [(i, len(t or ""), sha(t), *(("revisit", last[t]) if i is not None and t in last and last[t] != i else ("response", None))) for i, _, t in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc.payloads(chunks).collect())
    stored = {bytes(r.c) for r in chunks.where("record_type = 'response'").groupBy("record_id", "declared_digest").agg(F.expr("array_join(transform(array_sort(collect_set(struct(chunk_no, cast(chunk as string) as c))), x -> x.c), '')").cast("binary").alias("c")).where("record_id in (7, 9)").collect()}
    assert stored == {a.encode(), b.encode()}
    assert max(len(r.chunk) for r in chunks.collect()) == 400


def test_registered_warc_query_reads_chunks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.warc, "payloads", lambda chunks, own=warc.payloads: seen.append(chunks) or own(chunks))
    queries.op2_warc(spark, SF)
    n = seen[0].agg(F.sum(F.length("chunk"))).first()[0]
    assert n == seen[0].where("record_type = 'response' and chunk_no = 0").agg(F.sum("declared_bytes")).first()[0] > 0


@pytest.mark.parametrize("text", ["pay " + "".join(chr(0x660 + int(c)) for c in "4041894974608795"), "".join(chr(0x660 + int(c)) if c.isdigit() else c for c in "123-45-6789"), "GB82 WEST 1234 5698 7654 3K", "KW81 CBKU 0000 0000 0000 1234 5601 01", "+١ 212 555 0123", "١.2.3.4", "١999-01-02"])
def test_pii_leaves_other_digits_alone(text):
    assert pii.Pseudonyms(b"k").text(text) == (text, [0] * len(pii.KINDS))


def test_pii_over_a_whole_table(spark):
    """Outside values texts are unchanged; a value has one pseudonym of its shape in all documents, and no two values share one."""
    p, of, back = pii.Pseudonyms(b"k"), {}, {}
    rows = pii.pseudonymise(table(spark, SF, "documents").select("doc_id", "text", F.col("text").alias("n_card")), b"k").select("doc_id", "text").collect()
    before = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    n = 0
    for r in rows:
        old, at, rest = before[r.doc_id] or "", 0, r.text or ""
        while m := pii.PATTERN.search(old, at):
            kind, s = (m.lastgroup, m[0]) if m.lastgroup != "value" else ("secret", m["value"])
            at = m.end()
            if kind in ("iban",) or (new := p.value(kind, s)) is None:
                continue
            n += 1
            assert of.setdefault((kind, s), new) == new and back.setdefault((kind, new), s) == s
            assert kind in ("ip", "date") or shape(new) == shape(s)
            assert p.value(kind, new) is not None and new in rest
    assert n > 15


def brute_scan(s, text):
    """All rules without a prefilter, suppression by comparing all accepted intervals."""
    lower, taken = text.encode().lower().decode(), []
    found = [(r.priority, m.start() - m.end(), m.start(), m.end(), k) for k, r in enumerate(s.rules) for m in r.pattern.finditer(lower)]
    for _, _, b, e, k in sorted(found):
        if not any(x <= b and e <= y for x, y, _ in taken):
            taken.append((b, e, s.rules[k].label))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = sorted({x for _, x in places})
    labels = sorted({*base, *(x for _, _, x in taken)})
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), sorted((b, e, x) for b, e, x in taken)


def test_licenses_against_brute_force(spark):
    s, rng = licenses.Scanner(), random.Random(4)
    phrases = [re.sub(r"\(\?[:<!=].*?\)|[\\?(){}\[\]^$|*+]|\.\{.*?\}", " ", p) for _, p, _, _ in licenses.SIGNATURES]
    texts = [r.text or "" for r in table(spark, SF, "documents").collect()]
    parts = [*phrases, "gnu general public license", "mit license", "CC BY-SA 4.0", "apache  license\n", "SPDX-License-Identifier: GPL-2.0-or-later", "lesser general public license v2.1", "x", "y."]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    for t in texts:
        got = s.scan(t)
        assert (*got[:6], sorted((x["begin"], x["end"], x["label"]) for x in got[7])) == brute_scan(s, t)
    body = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files */"
    assert "mit" in s.scan(body)[5].split(",")
    began = time.time()
    s.scan("gnu lesser general public license 2.1 mit license gpl apache license " * 8000)
    assert time.time() - began < 20


def test_jaccard_of_repeated_doc_ids_and_hot_tiles(spark, monkeypatch):
    t, u, x, y = (" ".join(f"{k}{i}" for i in range(60)) for k in "tuxy")
    near = lambda s, k: " ".join([*s.split()[:58], k, k])
    rows = [(3, t), (5, near(t, "q")), (5, u), (8, near(u, "r")), (9, x), (9, x), (None, near(x, "z")), (10, y), (10, None), (11, "")]
    monkeypatch.setattr(jaccard, "CELL", 3)
    monkeypatch.setattr(jaccard, "FEW", 1)
    monkeypatch.setattr(jaccard, "COMMON", 1)
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    shared, rng = " ".join(f"c{i}" for i in range(24)), random.Random(1)
    rows += [(20 + k, f"{shared} " + " ".join(f"o{rng.randint(0, 3)}" for _ in range(rng.randint(0, 8)))) for k in range(80)]
    docs = spark.createDataFrame([(i, s, "en", "src0", 1, 1, True) for i, s in rows], DOCS)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id or -1) for r in jaccard.similar_components(docs).collect())
    assert got == brute_components(rows)


def test_tiles_hold_sets_with_partners_and_move_plain_columns(spark):
    """Every pair that may meet in a tile is kept; a set that meets nobody there isn't, and the shuffle of all places has four columns."""
    rng = random.Random(5)
    rows, classes = [], []
    for cid in range(400):
        n = rng.choice([1, 2, 5, 9, 10, 12, 40, 45, 50, 60, 200])
        keys = rng.sample(range(-40, 40), min(jaccard.prefix_length(n, 80), 30)) if cid % 3 else [100 + cid // 3]
        keys = sorted(keys, key=lambda k: k % 8 == 0)  # shingles that 8 divides are common, and last
        rare = sum(k % 8 != 0 for k in keys)
        classes.append((cid, n, keys, rare))
        rows += [(k, cid, n, pos) for pos, k in enumerate(keys)]
    tiles = jaccard.neighbours(spark.createDataFrame(classes, "cid long, n int, keys array<long>, rare int"), 80)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    moved = re.search(r"Exchange hashpartitioning.*\n.*Project \[(.*)\]", plan)[1]
    assert len(moved.split(" AS ")) == 3 and re.search(r"cid#\d+L, key#\d+L", moved) and "named_struct" not in moved
    got = {(r.key, r.cid): r for r in tiles.collect()}
    of, size = {}, {}
    for k, cid, n, pos in rows:
        of.setdefault(k, []).append((cid, n, pos))
        size[cid] = n
    apart = 0
    for k, sets in of.items():
        for cid, n, pos in sets:
            meets = any(cid != c and min(n - pos, m - p) >= -(-80 * (n + m) // 180) for c, m, p in sets)
            assert (k, cid) in got or not meets and k % 8
            if k % 8 and len(sets) <= 2:
                assert meets == ((k, cid) in got)
            apart += (k, cid) not in got and len(sets) > 1
    assert apart > 50
    for r in got.values():
        assert (r.n, r.pos) == next((n, pos) for cid, n, pos in of[r.key] if cid == r.cid)
        assert all(x is None or any((x.cid, x.n, x.pos) == y for y in of[r.key]) and (x.n, x.cid) < (r.n, r.cid) for x in (r.before, r.head))


def test_arrays_of_pairs_are_written_once_beside_copies(spark, monkeypatch):
    """Copies that a full bitmap lets through are no repeated rows, and of the tiles left open a join gets its own alone."""
    x, y = (" ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    near = lambda s, k: " ".join([*s.split()[:58], k, k])
    rows = [(i + 100 * k, t) for i, t in enumerate([x, near(x, "p"), y, near(y, "q")], 1) for k in range(3)]
    docs, names, stage = spark.createDataFrame([(i, s, "en", "src0", 1, 1, True) for i, s in rows], DOCS), [], jaccard.stage
    monkeypatch.setattr(jaccard, "in_bitmap", lambda words, values: np.ones(len(values), bool))
    monkeypatch.setattr(jaccard, "stage", lambda df, name: names.append(name) or stage(df, name))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect())
    assert got == brute_components(rows)
    assert names.count("pair-data") == names.count("decided") > 0
    some = spark.createDataFrame([(k,) for k in range(-5, 5)], "key long")
    monkeypatch.undo()
    assert sorted(r.key for r in jaccard.maybe_in(some, "key", util.bitmap(some.where("key in (-3, 4)"), "key")).collect()) == [-3, 4]


def test_clashing_column_names(spark):
    names = ["__text", "__gone", "__host", "__kept", "__doc_hash", "___gone", "gone", "host", "kept", "cleaned", "c0", "hash", "rep", "cid", "n", "key", "`odd.name`"]
    docs = spark.createDataFrame([(1, "one two three " * 20, "en", "s", 1, 1, True), (2, "clean words " + " ".join(f"w{i}" for i in range(60)), "en", "s", 1, 1, True)], DOCS).drop("kept")
    for n in names:
        docs = docs.withColumn(n.strip("`"), F.lit(n))
    bench = spark.createDataFrame([(1, "some item of the benchmark that is nowhere")], "item_id long, text string").withColumn("hash", F.lit("x")).withColumn("tokens", F.lit("y"))
    for out in (quality.clean(docs, texts_once=True), jaccard.keep_one(docs), decontam.remove_contaminated(docs, bench), pii.pseudonymise(docs, b"k", counts=False)):
        assert out.columns == docs.columns
        assert all(r[n.strip("`")] == n for r in out.collect() for n in names)
    assert util.unused(docs, "gone") == "____gone" and packing.pack(docs, queries.vocabulary("word_bpe_49k.json")).count() == 2


def brute_pipeline(rows, benchmark):
    """(doc_id, start, length, crc32, doc_tokens) of rows (doc_id, text, source), by plain loops over all rows and pairs."""
    of = {}
    norm = lambda line: b" ".join(words(line))
    for _, t, s in rows:
        for line in {norm(x) for x in (t or "").split("\n")} - {b""}:
            of.setdefault((s, line), set()).add(t)
    kept = []
    for i, t, s in rows:
        w = (t or "").encode().split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = {g for g in grams if grams.count(g) > 1}
        repeated = len({k + d for k, g in enumerate(grams) if g in often for d in range(3)})
        if len(w) < 50 or 100 * repeated > 50 * len(w):
            continue
        stay = [x for x in t.split("\n") if not norm(x) or len(of[s, norm(x)]) <= 20]
        if 100 * len(" ".join(stay).encode().split()) >= 50 * len(w):
            kept.append((i, "\n".join(stay), s))
    first = {i - 1: c - 1 for i, _, c in brute_components([(i + 1, t) for i, t, _ in kept])}  # 0 stands for no id there
    kept = [x for x in kept if first[x[0]] == x[0]]
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [tokens(t) for _, t in benchmark if t]

    def dirty(t):
        d = tokens(t)
        for m in items:
            least = min(20, len(m))
            for shift in range(-len(m) + 1, len(d)):
                i, j = max(0, -shift), min(len(m), len(d) - shift)
                if j - i < least:
                    continue
                equal = [d[shift + k] == m[k] for k in range(i, j)]
                if len(m) < 12 and not all(equal):
                    continue
                total = [0]
                for e in equal:
                    total.append(total[-1] + (20 if e else -80))
                if any(total[b] >= total[a] for a in range(len(total)) for b in range(a + least, len(total))):
                    return True
        return False

    p, tok = pii.Pseudonyms(queries.DEMO_KEY), Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    return {i: [*tok.encode(p.text(t)[0], add_special_tokens=False).ids, 2] for i, t, _ in kept if not dirty(t)}


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents").where(F.length("text") < 1500)
    item = " ".join(f"bench{i}" for i in range(24))
    menu = "\n".join(["Home About Contact", "read more of our stories"])
    base = lambda k, n=70: " ".join(f"w{k}x{i}" for i in range(n))
    extra = [(9000 + k, f"{menu}\n{base(k)}", "en", "src0", 1) for k in range(25)] + [(9100, base(1) + " tail", "en", "src1", 1), (9101, f"{base(200)} {item.replace('bench5 ', 'zz ')} end", "en", "src1", 1)]
    extra += [(9102, base(300) + " call +1 212 555 0123 or 8.8.8.8", "en", "src1", 1), (9103, None, "en", "src1", 1), (9104, "", None, None, 1), (9105, base(300, 69), "en", "src9", 1), (9105 + 1, base(400), "en", None, 1), (9107, base(400), "en", None, 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "nine words that stand nowhere in any of these")], "item_id long, text string")
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    want = brute_pipeline([(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(got) == set(want) and 9101 not in got and 9100 not in got and 9107 not in got
    for i, ids in want.items():
        assert sum(n for _, n, _, _ in got[i]) == len(ids)
        for start, n, crc, whole in got[i]:
            assert (zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n])), whole) == (crc, len(ids))


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = table(spark, SF, "documents").columns
    odd = spark.createDataFrame(ODD, DOCS).select(*columns)
    for docs in (odd, odd.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, str(tmp_path))
            n = out.count()
            assert name == "packing" or out.columns == columns
            assert n == 0 if not docs.count() else n >= 0


def test_pipeline_stages_write_themselves_in_small_batches(spark, tmp_path):
    """A caller's write of a stage would feed Python workers batches of 10,000 texts."""
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, SF, "documents").limit(50)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        assert "MapInArrow" not in docs._jdf.queryExecution().toString(), name
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_workers_drop_what_other_operators_left(spark, monkeypatch):
    """An encoder stays for the next tasks of its kind, and goes once the worker has a task of another operator."""
    docs, runs = table(spark, SF, "documents"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: runs.append(run) or spark.createDataFrame([], schema))
    quality.frequent_lines(docs)
    path = queries.vocabulary("word_bpe_49k.json")
    held = weakref.ref(tokens.encoder(path, False))
    assert tokens.encoder(path, False) is held()
    list(runs[0](iter([pa.RecordBatch.from_pydict({"text": ["some line"], "host": ["a"], "fp": [1]})])))
    gc.collect()
    assert held() is None

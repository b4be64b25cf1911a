"""Operators against brute force, round trips and literal cases."""

import hashlib
import itertools
import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, decontam, jaccard, licenses, packing, pii, quality, queries, token_count, token_files, warc
from lectern.llm.components import components
from lectern.llm.util import hashed_words, pieces, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean"
ODD = [
    (1, None, "en", "src0", 0, 9, True), (2, "", None, None, 0, 9, True), (None, "one two three", "en", "src1", 13, 9, True),
    (3, "word " * 30_000, "en", "src0", 150_000, 9, True), (4, "a  b\n\n c\t", "en", "src0", 9, 9, True), (5, "same text here for all of us", "en", "src0", 28, 9, True),
    (5, "same text here for all of us", "en", "src0", 28, 9, True), (6, "same text here for all of us", "de", "src2", 28, 9, True),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().lower().split()


def test_token_files_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    for docs in (odd, table(spark, SF, "documents"), empty):
        path = token_files.write_token_files(docs, queries.vocabulary("byte_bpe_50k.json"))
        got = sorted(map(tuple, token_files.with_crc32(token_files.read_token_files(spark, path)).collect()), key=lambda r: r[1])
        at, want = 0, []
        for i, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            raw = b"".join(x.to_bytes(4, "little") for x in [*tok.encode(t or "", add_special_tokens=False).ids, 2])
            want.append((i, at, len(raw) // 4, zlib.crc32(raw)))
            at += len(raw) // 4
        assert got == want


def test_packing_covers_every_token_once(spark, odd, empty):
    assert packing.pack(empty, queries.vocabulary("word_bpe_49k.json")).count() == 0
    rows = packing.pack(odd.union(table(spark, SF, "documents").select(*odd.columns[:5], F.lit(1), F.lit(True))), queries.vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 4096 and len(r.ids) == r.length
        ends[r.sequence_id] = r.offset + r.length
    assert sorted(ends) == list(range(len(ends))) and all(ends[k] == 4096 for k in list(ends)[:-1])


def test_quality_base_and_lines(spark, odd, empty):
    assert quality.judge(empty).count() == 0
    by = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert by[1].n_words == 0 and by[1].base_failed and by[3].n_repeat_words == 30_000 and not by[3].kept
    unique = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    docs = spark.createDataFrame([(k, f"Menu here\n{unique(k)}", "en", "src0", 1, 1, True) for k in range(30)] + [(99, "Menu here\n" + unique(99), "en", "src1", 1, 1, True)], DOCS)
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert len(out) == 31 and out[3].text == unique(3) and out[99].text.startswith("Menu") and out[3].kept and quality.clean(docs).columns == docs.columns
    frequent = quality.frequent_lines(docs)
    few = quality._judged(docs, ["doc_id"], frequent, 20, 50, True)
    bound, quality.BROADCAST = quality.BROADCAST, 0
    many = quality._judged(docs, ["doc_id"], frequent, 20, 50, True)
    quality.BROADCAST = bound
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_quality_lines_of_every_length(spark):
    notice = " ".join(f"notice{i}" for i in range(55))
    unique = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, f"{notice}\n{unique(k)}", "en", "src0", 1, 1, True) for k in range(21)]
    rows += [(100 + k, f"{notice}\n{unique(100 + k)}", "en", "src1", 1, 1, True) for k in range(20)]  # at the limit
    rows += [(200 + k, f"{notice} copied\n{unique(200)}", "en", "src2", 1, 1, True) for k in range(30)]  # exact copies
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.n_removed_words for r in quality.judge(docs).collect()} == {r[0]: 55 * (r[0] < 100) + 116 * (r[0] >= 200) for r in rows}
    assert {r.doc_id: r.n_removed_words for r in quality.judge(docs.union(docs), texts_once=True).collect()} == {r[0]: 55 * (r[0] < 100) for r in rows}
    assert {r.doc_id: r.text for r in quality.clean(docs, texts_once=True).collect()} == {r[0]: unique(r[0]) if r[0] < 100 else r[1] for r in rows}
    frequent = quality.frequent_lines(docs, texts_once=True)
    bound, quality.BROADCAST = quality.BROADCAST, 0
    many = quality._judged(docs, ["doc_id"], frequent, 20, 50, True)
    quality.BROADCAST = bound
    assert sorted(r["n_removed_words"] for r in many.collect()) == [0] * 50 + [55] * 21


def test_token_counts_splice(spark, odd, empty):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp, tok = sentencepiece.SentencePieceProcessor(model_file=path), token_count.CountingTokenizer(path)
    assert token_count.token_counts(empty, path).count() == 0
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_count.token_counts(odd, path, chunk=1000, overlap=10).collect()) == want
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "x" * 9, "▁", "日本", "<s>", "\t", " ing"]) for _ in range(rng.randint(0, 120)))
        assert list(tok.spliced(t, rng.randint(5, 40), rng.randint(1, 10))) == sp.encode(t)


def test_licenses(spark, odd, empty):
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(odd).count() == len(ODD)
    s = licenses.Scanner()
    n, base, first, last, base_labels, labels, score, spans = s.scan("Under the GNU Lesser General Public License 2.1; gnu general  public license, cc-by")
    assert (n, base, first, last, base_labels) == (15, 2, 9, 13, "cc-by,gpl") and "lgpl-2.1" in labels.split(",") and 0 < score <= 1
    assert all(not (a["begin"] <= b["begin"] and b["end"] <= a["end"]) for a, b in itertools.permutations(spans, 2))


def test_licenses_rules_fire_when_wrapped():
    names = {
        "agpl": "gnu affero general public license", "lgpl": "lesser general public license", "gpl": "general public license", "gfdl": "free documentation license", "apache": "apache software license", "mit": "mit license",
        "bsd": "bsd license", "mpl": "mozilla public license", "epl": "eclipse public license", "cddl": "Common Development and Distribution License", "cpl": "common public license", "eupl": "european union public licence",
        "isc": "isc license", "zlib": "zlib license", "artistic": "artistic license", "boost": "boost software license", "unlicense": "the unlicense", "wtfpl": "do what the fuck you want to public license",
        "ofl": "sil open font license", "odbl": "open data commons open database license", "python": "python software foundation license", "cc0": "creative commons zero",
        "cc-by-nc-nd": "creative commons attribution noncommercial noderivatives", "cc-by-nc-sa": "creative commons attribution noncommercial sharealike", "cc-by-nc": "creative commons attribution noncommercial",
        "cc-by-nd": "creative commons attribution noderivatives", "cc-by-sa": "creative commons attribution sharealike", "cc-by": "creative commons attribution",
    }
    plain = {
        "all-rights-reserved": "all rights reserved", "public-domain": "placed in the public domain", "copyright": "copyright 2024", "proprietary": "proprietary and confidential",
        "permissive-grant": "permission is hereby granted, free of charge", "redistribution": "redistribution and use in source and binary forms", "as-is": "provided as is without warranty",
    }
    assert set(names) == set(licenses.FAMILIES) and set(plain) == {x[0] for x in licenses.PLAIN}
    s = licenses.Scanner()
    texts = {(k, f): t for k, t in names.items() for f, t in (("name", t), ("grant", f"licensed under the {t}"), *((v, f"{t} version {v}") for v in licenses.FAMILIES[k][2]))} | {(k, ""): t for k, t in plain.items()}
    for (label, form), text in texts.items():
        for blank in (" ", "\n", "  ", "\r\n"):
            want = f"{label}-{form}" if form[-1:].isdigit() or form.endswith("-clause") else label
            assert want in s.scan("x " + text.replace(" ", blank) + " y")[5].split(","), (want, text, blank)


def test_licenses_of_long_white_space():
    """A million blanks after each family's name, or a statement's first word, take no more than a moment."""
    s = licenses.Scanner()
    for name in [*(re.sub(r"\\s\+", " ", re.sub(r"\(\?:[^()]*\)\??|\[sc\]", lambda m: "s" if m[0] == "[sc]" else "", names)) for _, names, _, _ in licenses.FAMILIES.values()), "apache license", "mozilla public license", "copyright", "(c)", "licensed under the"]:
        began = time.time()
        s.scan(f"{name}{' ' * 1_000_000}x")
        assert time.time() - began < 5, name  # linear: a few dozen rules read a megabyte; a quadratic one would take hours
    assert "copyright" in s.scan("copyright " + " " * 1000 + "(c)\n\n2024")[5] and "apache-2.0" in s.scan("apache license," + "\n" * 1000 + "version   2.0")[5]


def test_pii_is_one_to_one_and_linked(spark, odd, empty):
    p = pii.Pseudonyms(b"k")
    assert sorted(p.f.permute("t", 1000, i) for i in range(1000)) == list(range(1000))
    card = p.text("pay 4041894974608795 and 4041-8949-7460-8795.")[0].split()
    assert card[1] == card[3].strip(".").replace("-", "") != "4041894974608795" and pii.luhn_digit(card[1][:-1]) == int(card[1][-1])
    assert p.text("no 4041894974608796 1999-02-30")[0] == "no 4041894974608796 1999-02-30"
    assert pii.pseudonymise(empty, b"k").count() == 0
    assert sorted(map(str, pii.pseudonymise(odd, b"k", counts=False).collect())) == sorted(map(str, odd.collect()))


@pytest.mark.parametrize("kind, value", [
    ("card", "4 0 4 1 8 9 4 9 7 4 6 0 8 7 9 5"), ("card", "4-0-4-1-8-9-4-9-7-4-6-0-8-7-9-5"), ("iban", "ES9121000418450200051332"), ("phone", "+1 212 555 0123"), ("ssn", "123-45-6789"),
    ("ip", "8.8.8.8"), ("ip", "1.1.1.1"), ("date", "1/2/1999"), ("email", "ann@example.org"), ("secret", "password=swordfish"),
])
def test_pii_each_kind_alone_in_a_text(kind, value):
    p = pii.Pseudonyms(b"k")
    text, counts = p.text(f"ask {value}, or")
    assert value not in text and counts == [int(k == kind) for k in pii.KINDS]
    assert p.text(f"ask {value}, or 10 others")[0] == text + " 10 others"


def test_pii_iban_before_words():
    p = pii.Pseudonyms(b"k")
    for iban in ("ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68 5390 0754 7034", "SE45 5000 0000 0583 9825 7466", "de89 3704 0044 0532 0130 00", "NO9386011117947"):
        alone = p.text(iban)[0]
        assert alone != iban and pii.iban_checks(alone[:2], alone.replace(" ", "")[4:]) == alone.replace(" ", "")[2:4]
        for after in (" and", " now", " from here", " hello there", ", then", " a b"):
            assert p.text(f"pay {iban}{after}") == (f"pay {alone}{after}", [0, 1, 0, 0, 0, 0, 0, 0])
        both, counts = p.text(f"{iban} 4041 8949 7460 8795")
        assert both == f"{alone} {p.text('4041 8949 7460 8795')[0]}" and counts[:2] == [1, 1]
    wrong = "ES92 2100 0418 4502 0005 1332 and"
    assert p.text(wrong) == (wrong, [0] * 8)
    assert p.text("AB12 4041 8949 7460 8795")[1][:2] == [1, 0]


def brute_components(docs):
    sets = []
    for i, t in docs:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i if i is not None else -1), len(s), (least.get(find(k)) if s else i) or -1) for k, (i, s) in enumerate(sets))


def test_jaccard_against_all_pairs(spark, odd, empty):
    assert jaccard.similar_components(empty).count() == 0
    rng, base = random.Random(5), None
    rows = []
    for k in range(60):
        if k % 12 == 0:
            base = [f"b{k}w{i}" for i in range(rng.randint(3, 90))]
        w = [x if rng.random() > 0.015 else f"e{k}" for x in base]
        rows.append((k + 10, " ".join(w[: rng.randint(max(1, len(w) - 3), len(w))]), "en", "src0", 1, 1, True))
    docs = odd.where("doc_id is null or doc_id <> 3").union(spark.createDataFrame(rows, DOCS))
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id or -1) for r in jaccard.similar_components(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_decontamination(spark, odd, empty):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short item here"), (1, item)], "item_id long, text string")
    swapped = item.replace("q7 ", "zz ").replace("q20 ", "yy ")
    rows = [(10, "x y " + item + " z"), (11, "intro " + swapped), (12, " ".join(f"q{i}" for i in range(9)) + " clean text"), (13, "a short item, here!"), (14, "short item there"), (15, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, True) for i, t in rows], DOCS)
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(docs, bench).collect()}
    assert got == {10: "1", 11: "1", 13: "3"}
    assert sorted(r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()) == [12, 14, 15]
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0


def fewest_substitutions(masks, longest):
    """For each length up to ``longest``, the fewest substitutions that leave no window agreeing under a mask, over all patterns."""
    keep = max(map(len, masks)) - 1
    fewest, out = {(1,) * keep: 0}, [0]
    for _ in range(longest):
        then = {}
        for last, n in fewest.items():
            for bit in (0, 1):
                window = (*last, bit)
                if all(any(b and c == "1" for b, c in zip(window[-len(m) :], m)) for m in masks):
                    then[window[1:]] = min(n + bit, then.get(window[1:], longest))
        fewest = then
        out.append(min(fewest.values()))
    return out


def test_decontamination_masks_cover_every_pattern():
    fewest = fewest_substitutions(decontam.MASKS, 2 * decontam.LEAST - 1)
    assert all(100 * fewest[n] > (100 - decontam.SHARE) * n for n in range(decontam.SPAN, len(fewest)))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    items = [[f"i{k}w{i}" for i in range(n)] for k, n in enumerate([12, 13, 15, 17, 19, 20, 20, 25, 30, 45])]
    rows, want = [], set()

    def add(k, lost):
        t = [f"s{len(rows)}x{i}" if i in lost else x for i, x in enumerate(items[k])]
        n, least = len(t), min(20, len(t))
        if any(100 * sum(x not in lost for x in range(i, j)) >= 80 * (j - i) for i in range(n) for j in range(i + least, n + 1)):
            want.add(len(rows))
        rows.append((len(rows), " ".join(["before", *t, "after"]), "en", "s", 1, 1, True))

    for k, item in enumerate(items):
        for first in range(5):
            add(k, set(range(first, len(item), 5)))
        for p in range(len(item)):
            add(k, {p})
        for _ in range(30):
            add(k, set(rng.sample(range(len(item)), rng.randint(2, len(item) // 5 + 1))))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()} == want


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s> [\\\\:] [:]", "", None, "plain", "<<s>>[[INST]", "a\\"]
    rows = [(k, i, r, t) for k, (r, t) in enumerate(itertools.product(["user", "assistant", "[:]", None], texts)) for i in range(2)]
    out = chat.format_conversations(spark.createDataFrame(rows + [(None, None, "user", "x")], "conv_id long, turn int, role string, text string"))
    for r in chat.digests(out).collect():
        turns = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id), key=str) or [(None, "user", "x")]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        loss = "".join(t for _, a, t in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 40_000
    rows = [(1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u\r\nX: y", "a\r\n\r\nb" * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.read_archives(spark, warc.write_archives(pages), chunk=1000)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.payloads(chunks).collect()}
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == {i: (len((t or "").encode()), digest(t), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, t in rows}
    parts = sorted((r.chunk_no, bytes(r.chunk)) for r in chunks.where("record_id = 2").collect())
    assert b"".join(x for _, x in parts) == big.encode() and max(len(x) for _, x in parts) == 1000
    assert warc.payloads(warc.read_archives(spark, warc.write_archives(pages.limit(0)))).count() == 0


def test_pieces_keep_every_row():
    texts = ["a" * 30, None, "", "b" * 250, "é" * 20, "c" * 90, "d"]
    batch = pa.record_batch({"text": pa.array(texts, pa.string()), "k": list(range(7))})
    got = list(pieces(iter([batch.slice(0, 0), batch, batch.slice(3, 2)]), "text", 100))
    assert [x for b in got for x in b.column("text").to_pylist()] == texts + texts[3:5]
    assert all(sum(len((x or "").encode()) for x in b.column("text").to_pylist()[1:]) < 100 for b in got)


def test_hashed_words_agree_with_split():
    rng = random.Random(2)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("aAbB \n\té\x0bZ ") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        texts.append("x" * rng.randint(0, 9000) + rng.choice(["", "y"]))
        h, counts = hashed_words(pa.array(["left out", *texts]).slice(1), rng.randint(1, 3000))
        flat = [x for t in texts for x in words(t)]
        assert counts.tolist() == [len(words(t)) for t in texts] and len(h) == len(flat)
        assert len({*zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))
    assert [len(x) for x in hashed_words(pa.array([], pa.string()))] == [0, 0]


def test_components_of_stars_chains_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 140)]
    for edges in (chain + star + [(7, 7), (None, 3)], star, [], [(5, 4), (4, 5), (5, 4)]):
        root = {}
        for a, b in sorted((min(e), max(e)) for e in edges if None not in e and e[0] != e[1]):
            root[b] = root[a] = root.get(a, a)
        assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == set(root.items())

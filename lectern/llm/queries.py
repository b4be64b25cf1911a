"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, jaccard, lexical, licenses, merkle, packing, pii, quality, recompression, token_count, token_files, warc
from .util import table

#: The key of the registered query alone; a user of ``pii.pseudonymise`` passes a secret one.
DEMO_KEY = b"lectern-demonstration-key"


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; its path is a parameter of every operator that encodes."""
    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, DEMO_KEY)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.payloads(warc.read_archives(spark, manifest))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_files.with_crc32(token_files.read_token_files(spark, path))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.sql(r"SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(fixed)))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.lowered_claims())


QUERIES = {
    "op1_pii": op1_pii, "op2_warc": op2_warc, "op3_token_files": op3_token_files, "op4_quality": op4_quality, "op5_token_counts": op5_token_counts,
    "op6_licenses": op6_licenses, "op7_jaccard": op7_jaccard, "op8_decontamination": op8_decontamination, "op9_packing": op9_packing, "op10_chat": op10_chat,
    "op11_substrings": op11_substrings, "op12_search": op12_search, "op13_merkle": op13_merkle,
}



def _merkle_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** levels leaves, each level a grouping of the one below; a group that is down to one node keeps it."""

    def up(name: str, base: str) -> str:
        """Tables name0 to name<levels> of (g, i, h, n): all nodes of a level."""
        out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {base})"]
        for k in range(levels):
            place = "CASE WHEN n > 1 THEN i // 8 ELSE i END"
            out.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, {place} AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, n, {place}))")
        return ",\n".join(out)

    def siblings(name: str, k: int) -> str:
        """(g, i, l, r): of each node of a level the others of its run."""
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        return f"{name}s{k} AS (SELECT g, i, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})"

    def climb(name: str, start: str, key: str) -> str:
        """Proof text and folded digest of each row of ``start(…, g, i, x, p)`` from level to level."""
        out, last = [], start
        for k in range(levels):
            out.append(f"{name}c{k} AS (SELECT {key}, c.g, CASE WHEN s.n > 1 THEN c.i // 8 ELSE c.i END AS i, CASE WHEN s.n > 1 THEN sha256(s.l || c.x || s.r) ELSE c.x END AS x, c.p || s.l || s.r AS p FROM {last} c JOIN {name}s{k} s ON c.g = s.g AND c.i = s.i)")
            last = f"{name}c{k}"
        return ",\n".join(out)

    shown = lambda text: " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
    top = levels - 1
    return rf"""
        WITH RECURSIVE crc AS (
            SELECT doc_id, doc_id::VARCHAR AS d, 0 AS k, 0 AS b, 4294967295::BIGINT AS c FROM documents
            UNION ALL
            SELECT doc_id, d, CASE WHEN b = 8 THEN k + 1 ELSE k END, CASE WHEN b = 8 THEN 0 ELSE b + 1 END,
                   CASE WHEN b = 0 THEN xor(c, ascii(d[k + 1])::BIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END
            FROM crc WHERE k < len(d)),
        sums AS (SELECT doc_id, any_value(xor(c, 4294967295::BIGINT)) AS crc FROM crc WHERE k = len(d) GROUP BY doc_id),
        doc AS (SELECT d.*, crc % 3 = 0 AS tampered FROM documents d LEFT JOIN sums USING (doc_id)),
        leaf AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({shown("text")}) AS h,
                        sha256({shown("CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS claim FROM doc),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf),
        base AS (SELECT g, i, h FROM placed),
        {up("a", "base")},
        {",".join(siblings("a", k) for k in range(levels))},
        subs AS (SELECT g AS sub, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h FROM a{levels}),
        subbase AS (SELECT g, i, h FROM subs),
        {up("b", "subbase")},
        {",".join(siblings("b", k) for k in range(levels))},
        astart AS (SELECT doc_id, h AS leaf, g, i, claim AS x, '' AS p FROM placed),
        {climb("a", "astart", "c.doc_id, c.leaf")},
        bstart AS (SELECT c.doc_id, c.leaf, s.h AS subroot, s.g, s.i, c.x, c.p FROM ac{top} c JOIN subs s ON c.g = s.sub),
        {climb("b", "bstart", "c.doc_id, c.leaf, c.subroot")}
        SELECT doc_id, leaf, subroot, b{levels}.h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = b{levels}.h AS verified
        FROM bc{top}, b{levels}"""


WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
        FROM m""",
    "op4_quality": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, {WORDS} AS w, {WORDS.replace("text", "'a'")} AS x FROM d),
        p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
        g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM p),
        rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY r),
        l AS (SELECT r, doc_id, source, text AS doc, unnest(string_split(text, chr(10))) AS text FROM d),
        lw AS (SELECT r, doc_id, source, doc, text AS line, {WORDS} AS w FROM l),
        lk AS (SELECT r, doc_id, source, doc, line, len(w) AS n, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lw WHERE len(w) > 0),
        dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lk GROUP BY r),
        often AS (SELECT source, k FROM lk GROUP BY source, k HAVING count(DISTINCT (doc_id, doc)) > {quality.LIMIT}),
        gone AS (SELECT r, sum(n)::BIGINT AS n FROM lk JOIN often ON lk.k = often.k AND lk.source IS NOT DISTINCT FROM often.source GROUP BY r),
        b AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
              FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
               NOT base_failed AND 100 * (n_words - n_removed_words) >= {quality.KEEP_SHARE} * n_words AS kept
        FROM f""".replace(", regexp_extract_all('a', '[^\\x20\\x09-\\x0D]+') AS x", ""),
    "op7_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END) AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
        SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op10_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
        e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|:\])', '\1\\\2\3', 'g') AS erole, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|:\])', '\1\\\2\3', 'g') AS etext FROM c),
        -- a conversation is rendered as it is, unless one of its control strings, escaped or not, would be misread
        g AS (SELECT conv_id, bool_or(erole <> role OR etext <> text) AS odd FROM e GROUP BY conv_id),
        t AS (SELECT e.conv_id, turn, role, text, role = 'assistant' AS loss, CASE WHEN odd THEN erole ELSE role END AS r, CASE WHEN odd THEN etext ELSE text END AS x FROM e JOIN g USING (conv_id))
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (loss), '')) AS loss_sha256,
               sum(CASE WHEN loss THEN length(x) + 7 ELSE length(r) + length(x) + 16 END)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op11_substrings": rf"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.replace("text", "coalesce(text, '')")} AS w FROM documents),
        s AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
        m AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS again FROM s),
        c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM m WHERE again),
        p AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
        k AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.i) FILTER (c.r IS NULL) AS kept, count(c.r) AS gone FROM p LEFT JOIN c ON p.r = c.r AND p.i = c.i GROUP BY p.r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)""",
    "op12_search": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        s AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM t WHERE len(w) > 0),
        d AS (SELECT r, doc_id, 25 + (75 * len(w) * nn) // ll AS m, w FROM t, s WHERE len(w) > 0),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
        f AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term),
        q AS (SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM (SELECT row_number() OVER () AS q, * FROM benchmark)),
        sc AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
               FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r) GROUP BY q, r)
        SELECT item_id, rank::INT AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10""",
    "op13_merkle": _merkle_sql(),
}

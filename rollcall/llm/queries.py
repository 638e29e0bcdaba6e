"""The operators applied to the given tables, and the SQL that some must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm.chat import formatted_digests
from rollcall.llm.decontamination import contamination
from rollcall.llm.fill_middle import round_trip
from rollcall.llm.html_tree import extracted
from rollcall.llm.line_windows import without_repeated_windows
from rollcall.llm.merkle import manifest_report
from rollcall.llm.mixing import mix_counts
from rollcall.llm.multi_index import near_vectors
from rollcall.llm.packing import pack
from rollcall.llm.probminhash import near_duplicates
from rollcall.llm.quality import quality_report
from rollcall.llm.suffix_family import repeats_removed
from rollcall.llm.token_prefix import token_counts


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; such files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted and read back."""
    return formatted_digests(spark, table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document."""
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.93 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of three-line windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_windows(docs).select("doc_id", "n_lines", "n_removed", "text")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated strings of 50 bytes leaves of every document."""
    return repeats_removed(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are more than 4096."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mix_counts(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and read back."""
    return round_trip(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf, its proof, and whether the proof shows tampering."""
    return manifest_report(table(spark, sf_dir, "documents"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document has in common with test items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_packing": op5_packing,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

_CHAT_SQL = r"""
    WITH rows AS (
        SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
        UNION ALL
        SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL
        SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ),
    written AS (
        SELECT conv_id, turn, role, text,
               replace(replace(replace(replace(replace(replace(
                   text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
                   '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[ANS]', '[\ANS]') AS body,
               replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') AS head
        FROM rows
    )
    SELECT conv_id,
           CAST(COUNT(*) AS BIGINT) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
           CAST(SUM(length(CASE WHEN role = 'assistant'
               THEN '<s>[ANS] ' || head || chr(10) || body || '</s>'
               ELSE '<s>[INST] ' || head || chr(10) || body || '[/INST]' END)) AS BIGINT) AS formatted_chars
    FROM written
    GROUP BY conv_id
"""

_NEAR_TEXTS_SQL = r"""
    WITH RECURSIVE texts AS (
        SELECT MIN(doc_id) AS rep, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words
        FROM documents
        WHERE text IS NOT NULL
        GROUP BY text
    ),
    said AS (
        SELECT rep, UNNEST(words) AS word, generate_subscripts(words, 1) AS pos FROM texts
    ),
    five AS (
        SELECT rep, word || ' ' || LEAD(word) OVER doc || ' ' || LEAD(word, 2) OVER doc
                   || ' ' || LEAD(word, 3) OVER doc || ' ' || LEAD(word, 4) OVER doc AS shingle
        FROM said
        WINDOW doc AS (PARTITION BY rep ORDER BY pos)
    ),
    weights AS (
        SELECT rep, shingle, CAST(COUNT(*) AS DOUBLE) AS w
        FROM (SELECT rep, shingle FROM five WHERE shingle IS NOT NULL
              UNION ALL
              SELECT rep, array_to_string(words, ' ') FROM texts WHERE len(words) BETWEEN 1 AND 4)
        GROUP BY rep, shingle
    ),
    totals AS (
        SELECT rep, SUM(w) AS total FROM weights GROUP BY rep
    ),
    -- The similarity is at most the weight in common, of either.
    able AS (
        SELECT p.a, p.b, s.total AS total_a, t.total AS total_b, p.common_a
        FROM (SELECT x.rep AS a, y.rep AS b, SUM(x.w) AS common_a, SUM(y.w) AS common_b
              FROM weights x JOIN weights y ON y.shingle = x.shingle AND x.rep < y.rep
              GROUP BY x.rep, y.rep) p
        JOIN totals s ON s.rep = p.a
        JOIN totals t ON t.rep = p.b
        WHERE p.common_a >= 0.799 * s.total AND p.common_b >= 0.799 * t.total
    ),
    -- Of a shingle d in common: the sum over all shingles e of max(a_e / a_d, b_e / b_d).
    -- The first is the larger for those with a_e / b_e at least a_d / b_d.
    common AS (
        SELECT p.a, p.b, x.w AS wa, y.w AS wb,
               SUM(x.w) OVER larger + p.total_a - p.common_a AS sum_a,
               p.total_b - SUM(y.w) OVER larger AS sum_b
        FROM able p
        JOIN weights x ON x.rep = p.a
        JOIN weights y ON y.rep = p.b AND y.shingle = x.shingle
        WINDOW larger AS (PARTITION BY p.a, p.b ORDER BY x.w / y.w DESC
                          RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ),
    links AS (
        SELECT a, b FROM common GROUP BY a, b HAVING SUM(1 / (sum_a / wa + sum_b / wb)) >= 0.8 - 1e-9
    ),
    reach AS (
        SELECT rep AS node, rep AS low FROM texts
        UNION
        SELECT l.b, r.low
        FROM reach r
        JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.node AND r.low < l.b
    ),
    classes AS (
        SELECT node, MIN(low) AS class_id FROM reach GROUP BY node
    ),
    classed AS (
        SELECT d.doc_id, CASE WHEN len(t.words) > 0 THEN c.class_id ELSE d.doc_id END AS class_id
        FROM documents d
        LEFT JOIN texts t ON t.text = d.text
        LEFT JOIN classes c ON c.node = t.rep
    )
    SELECT doc_id, class_id, class_id = doc_id AS kept FROM classed
"""

_NEAR_VECTORS_SQL = """
    WITH RECURSIVE vectors AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
        FROM embeddings
        WHERE label IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (
        SELECT x.vec_id AS a, y.vec_id AS b
        FROM vectors x
        JOIN vectors y ON y.label = x.label AND y.vec_id <> x.vec_id
        WHERE list_cosine_similarity(x.v, y.v) >= 0.93
    ),
    reach AS (
        SELECT vec_id AS node, vec_id AS low FROM embeddings
        UNION
        SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node AND r.low < l.b
    ),
    components AS (
        SELECT node, MIN(low) AS component_id FROM reach GROUP BY node
    ),
    degrees AS (
        SELECT a, COUNT(*) AS n_links FROM links GROUP BY a
    )
    SELECT e.vec_id,
           CAST(COALESCE(n_links, 0) AS BIGINT) AS n_links,
           component_id,
           component_id = e.vec_id AS kept
    FROM embeddings e
    JOIN components c ON c.node = e.vec_id
    LEFT JOIN degrees d ON d.a = e.vec_id
"""

_LINES_SQL = """
    WITH lines AS (
        SELECT doc_id,
               UNNEST(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents
    ),
    windows AS (
        SELECT doc_id, pos,
               line || chr(10) || LEAD(line) OVER doc || chr(10) || LEAD(line, 2) OVER doc AS three
        FROM lines
        WINDOW doc AS (PARTITION BY doc_id ORDER BY pos)
    ),
    ranked AS (
        SELECT doc_id, pos, ROW_NUMBER() OVER (PARTITION BY three ORDER BY doc_id, pos) AS nth
        FROM windows
        WHERE three IS NOT NULL
    ),
    covered AS (
        SELECT DISTINCT doc_id, pos + i AS pos
        FROM ranked
        JOIN (VALUES (0), (1), (2)) AS steps(i) ON nth > 1
    ),
    kept AS (
        SELECT l.doc_id,
               COUNT(*) AS n_lines,
               COUNT(c.pos) AS n_removed,
               string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS text
        FROM lines l
        LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos
        GROUP BY l.doc_id
    )
    SELECT d.doc_id,
           CAST(COALESCE(n_lines, 0) AS INTEGER) AS n_lines,
           CAST(COALESCE(n_removed, 0) AS INTEGER) AS n_removed,
           CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(k.text, '') END AS text
    FROM documents d
    LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_REPEATS_SQL = """
    WITH bytes AS (
        SELECT doc_id, hex(encode(COALESCE(text, ''))) AS digits,
               strlen(COALESCE(text, '')) AS n_bytes
        FROM documents
    ),
    -- Stretches of 256 places, so that no string is cut out of a long text.
    stretches AS (
        SELECT doc_id, n_bytes, start, substr(digits, 2 * start + 1, 2 * (256 + 49)) AS part
        FROM (SELECT *, UNNEST(range(0, n_bytes - 49, 256)) AS start FROM bytes)
    ),
    strings AS (
        SELECT doc_id, start + i AS pos, substr(part, 2 * i + 1, 100) AS said
        FROM (SELECT *, UNNEST(range(0, LEAST(256, n_bytes - 49 - start))) AS i FROM stretches)
    ),
    first_met AS (
        SELECT said, MIN(doc_id) AS first_id FROM strings GROUP BY said HAVING MIN(doc_id) < MAX(doc_id)
    ),
    places AS (
        SELECT doc_id, pos, pos - LAG(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap
        FROM strings
        JOIN first_met USING (said)
        WHERE doc_id > first_id
    ),
    runs AS (
        SELECT doc_id, pos, COUNT(CASE WHEN gap <= 50 THEN NULL ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run
        FROM places
    ),
    spans AS (
        SELECT doc_id, MIN(pos) AS first_byte, MAX(pos) + 50 AS after FROM runs GROUP BY doc_id, run
    ),
    -- What is kept lies before the first span and after each.
    cuts AS (
        SELECT doc_id, first_byte, after FROM spans
        UNION ALL
        SELECT doc_id, NULL, 0 FROM bytes
    ),
    kept AS (
        SELECT doc_id, first_byte, after,
               LEAD(first_byte) OVER (PARTITION BY doc_id ORDER BY after) AS next_byte
        FROM cuts
    )
    SELECT b.doc_id,
           CAST(ANY_VALUE(b.n_bytes) AS BIGINT) AS n_bytes,
           CAST(COALESCE(SUM(k.after - k.first_byte), 0) AS BIGINT) AS n_removed,
           CAST(COUNT(k.first_byte) AS BIGINT) AS n_spans,
           sha256(unhex(string_agg(
               substr(b.digits, 2 * k.after + 1, 2 * (COALESCE(k.next_byte, b.n_bytes) - k.after)), '' ORDER BY k.after
           ))) AS kept_sha256
    FROM bytes b
    JOIN kept k ON k.doc_id = b.doc_id
    GROUP BY b.doc_id
"""

_MIDDLE_SQL = """
    WITH drawn AS (
        SELECT doc_id,
               COALESCE(text, '') AS text,
               regexp_extract_all(COALESCE(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
               sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ),
    numbers AS (
        SELECT doc_id, text, units, len(units) AS n,
               CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS x,
               CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                         OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm'
                    ELSE 'psm' END AS form
        FROM drawn
    ),
    parts AS (
        SELECT doc_id, text, n, form,
               array_to_string(list_slice(units, 1, LEAST(x, y)), '') AS prefix,
               array_to_string(list_slice(units, LEAST(x, y) + 1, GREATEST(x, y)), '') AS middle,
               array_to_string(list_slice(units, GREATEST(x, y) + 1, n), '') AS suffix
        FROM numbers
    )
    SELECT doc_id,
           CAST(n AS BIGINT) AS n,
           form,
           CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text
                            WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
"""

_MERKLE_SQL = """
    WITH RECURSIVE fields AS (
        SELECT ROW_NUMBER() OVER () AS r, doc_id, lang,
               COALESCE(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
                   || COALESCE(strlen(source) || ':' || source, '-')
                   || COALESCE(strlen(lang) || ':' || lang, '-') AS head,
               n_chars,
               COALESCE(strlen(text) || ':' || text, '-') AS tail,
               -- The checksum of the id's digits, bit by bit.
               xor(4294967295, list_reduce(
                   list_prepend(CAST(4294967295 AS BIGINT),
                                list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                   lambda crc, byte: list_reduce(
                       list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
                       lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 0 AS struck
        FROM documents
    ),
    digests AS (
        SELECT r, doc_id, lang,
               sha256(head || COALESCE(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
               CASE WHEN struck
                    THEN sha256(head || COALESCE(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail)
               END AS changed
        FROM fields
    ),
    leaves AS (
        SELECT *,
               DENSE_RANK() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
               ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               COUNT(*) OVER (PARTITION BY lang) AS n
        FROM digests
    ),
    nodes AS (
        SELECT 0 AS level, tree, i, n, leaf AS digest FROM leaves
        UNION ALL
        SELECT level + 1, tree, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
        FROM nodes
        WHERE n > 1
        GROUP BY level, tree, i // 2, n
    ),
    subroots AS (
        SELECT tree, digest, COUNT(*) OVER () AS n FROM nodes WHERE n = 1
    ),
    upper_nodes AS (
        SELECT 0 AS level, tree AS i, n, digest FROM subroots
        UNION ALL
        SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
        FROM upper_nodes
        WHERE n > 1
        GROUP BY level, i // 2, n
    ),
    climb AS (
        SELECT r, 0 AS level, tree, i, n, COALESCE(changed, leaf) AS folded, '' AS proof FROM leaves
        UNION ALL
        SELECT c.r, c.level + 1, c.tree, c.i // 2, (c.n + 1) // 2,
               sha256(CASE WHEN c.i % 2 = 0 THEN c.folded || COALESCE(s.digest, '') ELSE s.digest || c.folded END),
               c.proof || COALESCE(s.digest, '')
        FROM climb c
        LEFT JOIN nodes s ON s.level = c.level AND s.tree = c.tree AND s.i = xor(c.i, 1)
        WHERE c.n > 1
    ),
    upper_climb AS (
        SELECT c.r, 0 AS level, c.tree AS i, s.n, c.folded, c.proof
        FROM climb c
        JOIN subroots s ON s.tree = c.tree
        WHERE c.n = 1
        UNION ALL
        SELECT c.r, c.level + 1, c.i // 2, (c.n + 1) // 2,
               sha256(CASE WHEN c.i % 2 = 0 THEN c.folded || COALESCE(s.digest, '') ELSE s.digest || c.folded END),
               c.proof || COALESCE(s.digest, '')
        FROM upper_climb c
        LEFT JOIN upper_nodes s ON s.level = c.level AND s.i = xor(c.i, 1)
        WHERE c.n > 1
    )
    SELECT l.doc_id, l.leaf, s.digest AS subroot, top.digest AS root,
           sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = top.digest AS verified
    FROM leaves l
    JOIN subroots s ON s.tree = l.tree
    JOIN upper_climb u ON u.r = l.r AND u.n = 1
    JOIN upper_nodes top ON top.n = 1
"""

_BENCHMARK_SQL = r"""
    WITH items AS (
        SELECT item_id, regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM benchmark
    ),
    sized AS (
        SELECT item_id, words, LEAST(len(words), 10) AS width FROM items WHERE len(words) > 0
    ),
    windows AS (
        SELECT DISTINCT item_id, width, array_to_string(list_slice(words, pos, pos + width - 1), ' ') AS said
        FROM (SELECT item_id, words, width, UNNEST(range(1, len(words) - width + 2)) AS pos FROM sized)
    ),
    docs AS (
        SELECT doc_id, COALESCE(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
        FROM documents
    ),
    places AS (
        SELECT doc_id, pos, width, array_to_string(list_slice(words, pos, pos + width - 1), ' ') AS said
        FROM (SELECT doc_id, words, width, UNNEST(range(1, len(words) - width + 2)) AS pos
              FROM docs, (SELECT DISTINCT width FROM windows))
    ),
    hits AS (
        SELECT p.doc_id, p.pos, p.width, w.item_id
        FROM places p
        JOIN windows w ON w.width = p.width AND w.said = p.said
    ),
    hit_words AS (
        SELECT doc_id, COUNT(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, UNNEST(range(pos, pos + width)) AS place FROM (SELECT DISTINCT doc_id, pos, width FROM hits))
        GROUP BY doc_id
    ),
    hit_items AS (
        SELECT doc_id, COUNT(*) AS n_items, string_agg(said_id, ',' ORDER BY said_id) AS ids
        FROM (SELECT DISTINCT doc_id, COALESCE(CAST(item_id AS VARCHAR), '') AS said_id FROM hits)
        GROUP BY doc_id
    )
    SELECT d.doc_id,
           CAST(len(d.words) AS BIGINT) AS n_words,
           CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
           sha256(COALESCE(ids, '')) AS items_sha256,
           COALESCE(n_hit, 0) > 0 AS contaminated
    FROM docs d
    LEFT JOIN hit_words w ON w.doc_id = d.doc_id
    LEFT JOIN hit_items i ON i.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": _CHAT_SQL,
    "op4_minhash_near_dedup": _NEAR_TEXTS_SQL,
    "op6_embedding_near_dedup": _NEAR_VECTORS_SQL,
    "op7_line_dedup": _LINES_SQL,
    "op8_suffix_array_dedup": _REPEATS_SQL,
    "op11_fill_in_middle": _MIDDLE_SQL,
    "op12_merkle_manifest": _MERKLE_SQL,
    "op13_benchmark_decontamination": _BENCHMARK_SQL,
}

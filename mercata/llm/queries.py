"""The registered queries of the operators, and their SQL where it exists.

Each query reads its whole table, applies its operator with production
parameters and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_and_decode
from .common import read_table, tokenizer_path
from .exact_dedup import exact_dedup
from .html_text import extract
from .language_id import identify
from .lexical_search import lexical_search
from .license_scan import BETWEEN, GAP, SHARE, SHORT, TEMPLATES, grams_needed, license_scan
from .mixing import mix
from .near_dedup import near_dedup
from .pii import find_pii
from .substring_dedup import substring_dedup
from .token_files import read_token_files, scratch_dir, write_token_files
from .top_k import top_k
from .vector_code import ENTRIES, PARTS, ROUNDS, compress, digest, label_errors


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    index = write_token_files(read_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("word_bpe_49k.json"), scratch_dir(spark))
    return read_token_files(index)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), keep_text=False)


def op8_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return encode_and_decode(read_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("byte_bpe_50k.json"), ids=False, decoded=False)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"), redacted=False)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op13_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_text": op2_html_text,
    "op3_token_files": op3_token_files,
    "op4_top_k": op4_top_k,
    "op5_language_id": op5_language_id,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_mix_sources": op10_mix_sources,
    "op11_lexical_search": op11_lexical_search,
    "op12_license_scan": op12_license_scan,
    "op13_vector_code": op13_vector_code,
}


def _license_sql() -> str:
    """Templates as a table of grams; the votes as joins of neighbouring words."""
    grams = [
        (n, i, f"'{a}'", f"'{b}'", f"'{t.label}'", str(t.base).upper(), len(t.grams), grams_needed(t, SHARE, SHORT))
        for n, t in enumerate(TEMPLATES)
        for i, (a, b) in enumerate(t.grams)
    ]
    values = ", ".join(f"({', '.join(map(str, g))})" for g in grams)
    return rf"""
        WITH t(template, i, a, b, label, base, grams, need) AS (VALUES {values}),
        d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}'), lambda x: x <> '') AS w
            FROM documents
        ), g AS (
            SELECT r, p - 1 AS p, w[p] AS a, w[p + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS p FROM d)
        ), diag AS (
            SELECT r, template, label, base, grams, need, p - i AS s, bit_or(1::BIGINT << i) AS bits
            FROM g JOIN t USING (a, b) GROUP BY ALL
        ), span AS (
            SELECT *, CASE WHEN need = grams THEN bit_count(bits) ELSE bit_count(bit_or(bits) OVER (
                PARTITION BY r, template ORDER BY s RANGE BETWEEN CURRENT ROW AND {GAP} FOLLOWING)) END AS found
            FROM diag
        ), doc AS (
            SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(found::DOUBLE / grams) AS score
            FROM span WHERE found >= need GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
               CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
        FROM d LEFT JOIN doc USING (r)
    """


def _code_sql() -> str:
    """Rounds of a codebook: assign by a window over all entries, then average."""
    ctes = [
        rf"""e AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
        ), x AS (
            SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS y FROM e, range(0, {PARTS}) AS t(p)
        ), book0 AS (SELECT p, r - 1 AS n, y AS c FROM x WHERE r <= {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        ctes.append(
            f"""far{k} AS (
            SELECT r, x.p, n, y, list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS away FROM x JOIN book{k} b ON b.p = x.p
        ), near{k} AS (
            SELECT * FROM far{k} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY away, n) = 1
        )"""
        )
        if k < ROUNDS:
            ctes.append(
                f"""mean{k} AS (
            SELECT p, n, list(m ORDER BY d) AS c FROM (
                SELECT p, n, d, CAST((sum(z) - ((sum(z) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
                FROM (SELECT p, n, unnest(y) AS z, generate_subscripts(y, 1) AS d FROM near{k}) GROUP BY p, n, d
            ) GROUP BY p, n
        ), book{k + 1} AS (SELECT b.p, b.n, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.n = b.n)"""
            )
    return (
        "WITH "
        + ", ".join(ctes)
        + f""", coded AS (
            SELECT r, string_agg(printf('%02x', n), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r
        ), text AS (
            SELECT sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY p, n, d)) AS codebooks_sha256
            FROM (SELECT p, n, unnest(c) AS z, generate_subscripts(c, 1) AS d FROM book{ROUNDS})
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM e JOIN coded USING (r), text"""
    )

ORACLE_SQL = {
    "op4_top_k": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM e q JOIN e c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept,
               text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op6_minhash_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM d WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id
        ), both_have AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * common >= 75 * (x.size + y.size - common)
        ), way AS (
            SELECT a, b FROM link UNION ALL SELECT b, a FROM link
        ), reach AS (
            SELECT a, b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a
        ), least AS (
            SELECT a, min(b) AS b FROM reach GROUP BY a
        )
        SELECT d.doc_id, coalesce(size, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON a = d.doc_id
    """,
    "op7_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), win AS (
            SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS words
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)
        ), hit AS (
            SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY words) AS first FROM win) WHERE first < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, s + j AS p FROM hit, range(0, 13) AS t(j)
        ), kept AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS words, count(*) AS n
            FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ), i AS (
            SELECT row_number() OVER () AS k, item_id, unnest(list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
            FROM benchmark
        ), facts AS (
            SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
        ), tf AS (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL
        ), df AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, facts GROUP BY term, n_docs
        ), s AS (
            SELECT k, item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM i JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r), facts GROUP BY k, item_id, r
        ), best AS (
            SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best WHERE rank <= 20
    """,
    "op12_license_scan": _license_sql(),
    "op13_vector_code": _code_sql(),
}

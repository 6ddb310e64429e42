"""The contract's queries: each operator over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, erasure, langid, lexical, lm, media, minhash_dedup, packing, quality, secrets, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.duplicate_report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_report(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_report(table(spark, sf_dir, "pages")).drop("archive", "at")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_report(table(spark, sf_dir, "documents"))


def op13_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.erasure_report(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_lm_score": op4_lm_score,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_media_columns": op8_media_columns,
    "op9_language_id": op9_language_id,
    "op10_secret_scan": op10_secret_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_bpe": op12_bpe,
    "op13_erasure": op13_erasure,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Queries that SQL can express; tests/llm holds the others against brute force, round trips or held-out labels.
ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY body) AS first FROM p),
        k AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
            regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM pages),
        o AS (SELECT page_id, captured, concat(array_to_string(list_reverse(string_split(host, '.')), ','), ')', CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS url_key FROM k)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), '') AS payload_digest,
            CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
            url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position FROM d JOIN o USING (page_id)""",
    "op7_decontamination": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT row_number() OVER () AS item, item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        bw AS (SELECT item, item_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
        dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
        h AS (SELECT doc_id, item, item_id, i, p, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
        c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM h) GROUP BY 1),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1),
        s AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, p - i ORDER BY p) AS island FROM h),
        r AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS longest_item, min(p) - 1 AS longest_at, count(*) + n - 1 AS longest FROM s GROUP BY doc_id, item, item_id, p - i, island, n),
        l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, longest_at, longest_item NULLS LAST) AS nth FROM r)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0) AS longest, longest_at, longest_item
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN l ON l.doc_id = d.doc_id AND nth = 1""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {WORDS} AS w FROM documents), g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
        p AS (SELECT doc, doc_id, len(w) AS n, unnest(w) AS term FROM d), t AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, g GROUP BY term, n_docs),
        q AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark),
        s AS (SELECT item_id, doc, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score
            FROM q JOIN f USING (term) JOIN t USING (term), g GROUP BY item_id, doc, doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 50""",
}

"""Queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, line_dedup, packing, quality, simhash, token_records, toxicity, url_filter, warc

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark, sf_dir):
    """Whole texts as ids of a byte vocabulary, packed; a row for each piece with its bin's digest."""
    return packing.plan_of(packing.pack_texts(_table(spark, sf_dir, "documents")))


def op2(spark, sf_dir):
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"))


def op3(spark, sf_dir):
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op4(spark, sf_dir):
    return token_records.token_records(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op8(spark, sf_dir):
    r = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op9(spark, sf_dir):
    r = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1,
    "op2_simhash_near_dedup": op2,
    "op3_warc_salvage": op3,
    "op4_token_records": op4,
    "op5_quality_cotraining": op5,
    "op6_toxicity_kneser_ney": op6,
    "op7_url_bloom_cascade": op7,
    "op8_benchmark_decontamination": op8,
    "op9_line_dedup": op9,
    "op10_exact_dedup": op10,
}

SQL = {
    "op3_warc_salvage": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM q LEFT JOIN f USING (payload_digest)""",
    "op7_url_bloom_cascade": r"""
        WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^?#]*)', 1, 's'), '') AS rest, contains(coalesce(url, ''), '://') AS ok FROM pages),
        s AS (SELECT page_id, CASE WHEN ok THEN lower(regexp_extract(rest, '^([^/]*)', 1, 's')) ELSE '' END AS host,
                     CASE WHEN ok THEN regexp_extract(rest, '^[^/]*(.*)$', 1, 's') ELSE '' END AS path FROM u),
        r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
              FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)""",
    "op8_benchmark_decontamination": r"""
        WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS t
                FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS s FROM iw WHERE len(w) > 0)),
        ns AS (SELECT DISTINCT n FROM win),
        g AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
              FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM dw, ns WHERE len(w) >= n)),
        hit AS (SELECT g.doc_id, g.s, g.n, win.item_id FROM g JOIN win USING (n, t)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}

"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from introngrid.llm import align, exact, langid, mix, packing, pq, search, simhash, substring, tokenbin, tokens, urls, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark, sf_dir):
    return mix.mix_sizes(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark, sf_dir):
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_warc(spark, sf_dir):
    return warc.archive_round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op4_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_simhash(spark, sf_dir):
    return simhash.simhash_groups(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_token_matrices(spark, sf_dir):
    return tokenbin.packed_matrices(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_embedding_dedup(spark, sf_dir):
    return pq.embedding_groups(_read(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark, sf_dir):
    return exact.exact_groups(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_langid(spark, sf_dir):
    return langid.predict_languages(_read(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_lexical_search(spark, sf_dir):
    return search.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark, sf_dir):
    return align.align_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_url_filters(spark, sf_dir):
    return urls.judge_urls(_read(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix, op2_token_counts, op3_warc, op4_substring_dedup, op5_simhash, op6_token_matrices, op7_embedding_dedup, op8_exact_dedup, op9_langid, op10_packing, op11_lexical_search, op12_token_alignment, op13_url_filters)}


ORACLES = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, true AS valid
        FROM f""",
    "op4_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
        r AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
        t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM t ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        s AS (SELECT count(*) AS total, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) x GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term) f, s),
        g AS (
            SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length)))) AS BIGINT) AS score
            FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0) k WHERE rank <= 50""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

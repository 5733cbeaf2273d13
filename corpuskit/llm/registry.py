"""The registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm._shared import new_path, split_of, table, tokenizer_path


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.main_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.bpe import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe(docs, tokenizer_path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.warc import read_warc, write_warc

    archives = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    got = read_warc(spark, archives, ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.hmm_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), split_of(F.col("doc_id"), 7) != 2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.token_files import read_token_files, with_crc32, write_token_files

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return with_crc32(read_token_files(spark, path)).withColumnRenamed("key", "doc_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", split_of(F.col("doc_id"), 4) == 2)
    model = train(docs.filter("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.vectors_near import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_ngram_join": op2_ngram_join,
    "op3_bpe": op3_bpe,
    "op4_top_k": op4_top_k,
    "op5_warc": op5_warc,
    "op6_hmm": op6_hmm,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_language": op9_language,
    "op10_near_vectors": op10_near_vectors,
}
#: A text's words, A-Z lower-cased, as DuckDB's list.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLES = {
    "op2_ngram_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {SQL_WORDS} AS words FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) END) AS shingle
            FROM w WHERE len(words) > 0
        ), n AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), links AS MATERIALIZED (
            SELECT p.a, p.b
            FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL) p
            JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
            WHERE 100 * p.shared >= 90 * (x.n + y.n - p.shared)
        ), reach AS (
            SELECT doc_id AS node, doc_id AS met FROM documents
            UNION
            SELECT reach.node, links.b FROM reach JOIN links ON reach.met = links.a
        ), c AS (
            SELECT node, min(met) AS component_id FROM reach GROUP BY node
        )
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
    """,
    "op4_top_k": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.own, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.own <> b.own
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to
        FROM f
    """,
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS at
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
        ), w AS (
            SELECT source, n, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight FROM s
        ), filled AS (
            -- sources in the order in which they reach twice their size
            SELECT *, 2 * n / weight AS full_at, coalesce(sum(2 * n) OVER before, 0) AS given, sum(weight) OVER rest AS free, 1.5 * sum(n) OVER () AS total
            FROM w
            WINDOW before AS (ORDER BY 2 * n / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                rest AS (ORDER BY 2 * n / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ), unit AS (
            SELECT min_by((CAST(total AS DOUBLE) - given) / free, full_at) AS unit FROM filled WHERE (CAST(total AS DOUBLE) - given) / free <= full_at
        ), t AS (
            SELECT source, n, CASE WHEN unit IS NULL OR unit * weight > 2 * n THEN CAST(2 * n AS DOUBLE) ELSE unit * weight END AS target FROM w, unit
        ), placed AS (
            SELECT d.doc_id, d.size, d.source, t.n AS source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
                coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source, source_size, target,
            CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - start)) END AS BIGINT) AS taken
        FROM placed
    """,
    "op10_near_vectors": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT row_number() OVER () AS own, vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
                label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS usable
            FROM embeddings
        ), u AS MATERIALIZED (
            SELECT own, vec_id, label, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS length FROM v WHERE usable
        ), links AS MATERIALIZED (
            SELECT a.own AS a, b.own AS b, b.vec_id
            FROM u a JOIN u b ON a.label = b.label AND a.own <> b.own AND len(a.x) = len(b.x)
            WHERE a.length > 0 AND b.length > 0 AND list_dot_product(a.x, b.x) / (a.length * b.length) >= 0.93
        ), reach AS (
            SELECT own, own AS at, vec_id FROM v
            UNION
            SELECT reach.own, links.b, links.vec_id FROM reach JOIN links ON reach.at = links.a
        ), c AS (
            SELECT own, min(vec_id) AS component_id FROM reach GROUP BY own
        )
        SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE links.a = v.own) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c USING (own)
    """,
}

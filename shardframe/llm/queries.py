"""The corpus operators' queries and their SQL: each applies its operator to the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardframe.llm import exact_dedup, langid, media, mixing, ngram_join, packing, secret_scan, substring_dedup, token_counts, training_order


#: DuckDB: doc_id and its words, cut at runs of space and the control characters 9 to 13.
WORDS = r"""SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents"""
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.secret_report(docs, secret_scan.fit_models(docs))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_secret_scan, op2_exact_dedup, op3_media, op4_packing, op5_language_id, op6_substring_dedup, op7_token_counts, op8_mixing, op9_ngram_join, op10_training_order]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                   count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents""",
        "op6_substring_dedup": f"""
            WITH d AS ({WORDS}),
            starts AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM d),
            windows AS (SELECT s.doc_id, s.i, min(s.doc_id) OVER (PARTITION BY array_to_string(d.words[s.i:s.i + 49], ' ')) AS earliest
                        FROM starts s JOIN d USING (doc_id)),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows WHERE earliest < doc_id),
            word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS j FROM d),
            kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
            SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
            FROM d LEFT JOIN kept USING (doc_id)""",
        "op9_ngram_join": f"""
            WITH RECURSIVE d AS ({WORDS.replace("coalesce(text, '')", LOWER)}),
            shingle AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
                        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
            size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
            link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
                     GROUP BY a.doc_id, b.doc_id
                     HAVING 100 * count(*) >= 75 * ((SELECT n FROM size WHERE doc_id = a.doc_id) + (SELECT n FROM size WHERE doc_id = b.doc_id) - count(*))),
            reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
            SELECT d.doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
            FROM d LEFT JOIN size USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
    }

"""The registered queries of the training-data operators, over the whole given tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import collocation, cover_tree, exact_dedup, language, lm, mixing, ngram_join, packing, pieces, quality, secrets, tokenizing, variants


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.token_counts(read(spark, sf_dir, "documents"))


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), words=4, threshold=(85, 100))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs, net)


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest, F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(read(spark, sf_dir, "documents"), typo_every=97))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_cover_tree, op3_token_counts, op4_maxent_lm, op5_ngram_join, op6_secret_scan, op7_exact_dedup, op8_language_id, op9_packing, op10_quality, op11_piece_encoding, op12_collocations, op13_spelling_variants)}

ORACLE_SQL = {
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
            FROM documents),
        phrases AS (
            SELECT lang, 1 AS m, unnest(w) AS phrase FROM pieces
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces),
        f AS (SELECT lang, m, phrase, count(*) AS n FROM phrases GROUP BY ALL),
        words AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
        c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10),
        cuts AS (SELECT *, unnest(range(1, m)) AS k FROM c),
        parts AS (SELECT *, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:m], ' ') AS p2 FROM cuts),
        scored AS (
            SELECT parts.lang, parts.phrase, a, f1.n AS l, f2.n AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(f1.n AS HUGEINT) * f2.n) AS BIGINT) AS score
            FROM parts JOIN f f1 ON f1.lang = parts.lang AND f1.m = k AND f1.phrase = p1 JOIN f f2 ON f2.lang = parts.lang AND f2.m = parts.m - k AND f2.phrase = p2
            QUALIFY row_number() OVER (PARTITION BY parts.lang, parts.phrase ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, phrase, max(a) AS a FROM (
                SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE m = 3
                UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE m = 3) GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM scored JOIN words USING (lang)
        WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = scored.lang AND longer.phrase = scored.phrase AND 100 * longer.a >= 50 * scored.a)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}

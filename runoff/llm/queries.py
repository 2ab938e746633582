"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runoff.llm import license_scan
from runoff.llm.common import new_path, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.exact_dedup import find_copies

    return find_copies(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.ngram_join import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), 24, new_path(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.license_scan import scan, summary

    return summary(scan(table(spark, sf_dir, "documents")))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.token_scan import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-files"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runoff.llm.secret_scan import scan, summary

    return summary(scan(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_ngram_join, op3_toxicity, op4_sharding, op5_license_scan, op6_nearest, op7_packing, op8_token_counts, op9_mixing, op10_secret_scan)}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op2_ngram_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
        grams AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM words),
        sets AS (SELECT g, len(g) AS n, min(doc_id) AS set_id, count(*) AS set_size FROM grams GROUP BY g),
        posted AS (SELECT set_id, n, set_size, unnest(g) AS gram FROM sets),
        shared AS (SELECT a.set_id AS x, b.set_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, any_value(b.set_size) AS size, count(*) AS k
                   FROM posted a JOIN posted b ON a.gram = b.gram AND a.set_id <> b.set_id GROUP BY 1, 2),
        links AS (SELECT x, y, size FROM shared WHERE k / (nx + ny - k) >= 0.8),
        reach AS (SELECT set_id AS x, set_id AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
        class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
        degree AS (SELECT x, sum(size) AS d FROM links GROUP BY x)
        SELECT grams.doc_id, class_id, set_id, set_size, CAST(coalesce(d, 0) + set_size - 1 AS BIGINT) AS n_links
        FROM grams JOIN sets ON grams.g = sets.g JOIN class ON class.x = set_id LEFT JOIN degree ON degree.x = set_id""",
    "op9_mixing": """
        WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0)) AS b FROM documents GROUP BY source),
        rate AS (SELECT source, CASE WHEN b > 0 THEN pow(b, 0.7) / sum(pow(b, 0.7)) OVER () * (sum(b) OVER () / b) ELSE 1.0 END AS r FROM sizes),
        steps AS (SELECT source, r, k, -r + sum(CASE WHEN k = 0 THEN 0 ELSE ln(r) - ln(k) END) OVER (PARTITION BY source ORDER BY k) AS lp
                  FROM (SELECT source, r, unnest(range(0, CAST(floor(r + 12 * sqrt(r) + 40) AS BIGINT) + 1)) AS k FROM rate)),
        cdf AS (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
        cdfs AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
        drawn AS (SELECT d.doc_id, d.source, d.text, len(list_filter(cs, lambda c: c <= (CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS UBIGINT) + 0.5) / 4503599627370496.0)) AS n
                  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source),
        copies AS (SELECT doc_id, source, text, unnest(range(0, n)) AS copy FROM drawn)
        SELECT doc_id, source, text, copy, CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)), 17, 15) AS BIGINT) AS order_key
        FROM copies""",
    "op5_license_scan": license_scan.oracle_sql(),
}

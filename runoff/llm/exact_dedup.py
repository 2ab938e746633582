"""Exact dedup by a tree merge of sorted digest runs.

Each input partition is a run. Rounds are binomial with a radix of 2**BITS in place of two. Before a round's exchange, Spark's sort-based partial aggregation sorts the run by
digest and leaves one entry for each digest in it; the exchange sends the entries of 2**BITS neighbouring runs to the
holder of their merged run, split by digest so that no holder takes a whole run alone; the sort-based final
aggregation is the multiway merge. Every entry carries the identifier that stays and the number of rows so far. Texts
count as equal only where SHA-256, length and a second, unrelated 64-bit hash all agree, at every level.

Defined results: null text counts as empty; a text of any length is one value, of which only digests are shuffled by
`find_copies`. A null identifier ranks below every other. Rows repeated in full are one
document: all bear the same keep_id and `kept`, each counts in group_size, and `deduplicate` returns one of them.
Empty tables give empty results. Extra columns are ignored by `find_copies` and returned by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.llm.common import attach, durable

#: Runs that meet in one round: 2**BITS; rounds; so 2**(BITS * ROUNDS) runs are told apart.
BITS, ROUNDS = 5, 2
KEY = ["_sha", "_len", "_xx"]


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("_id"),
        F.unhex(F.sha2(whole, 256)).alias("_sha"),
        F.octet_length(whole).alias("_len"),
        F.xxhash64(whole).alias("_xx"),
    )


def merge_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each text: its verified digest, keep_id and group_size."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    # The row count inside the struct makes the buffer variable-width, which Spark aggregates by sorting.
    runs = _narrow(docs, doc_id, text).select(
        F.pmod(F.spark_partition_id(), F.lit(2 ** (BITS * ROUNDS))).alias("_run"), *KEY, F.struct("_id").alias("_best"), F.lit(1).cast("long").alias("_n")
    )
    if keep == "smallest":  # a null identifier ranks lowest, so it never is the smallest unless it is alone
        runs = runs.withColumn("_best", F.struct(F.isnull("_best._id").alias("_none"), F.col("_best._id").alias("_id")))
    for _ in range(ROUNDS):
        runs = runs.withColumn("_run", F.shiftright("_run", BITS)).groupBy("_run", *KEY).agg(best("_best").alias("_best"), F.sum("_n").alias("_n"))
    return runs.select(*KEY, F.col("_best._id").alias("keep_id"), F.col("_n").alias("group_size"))


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    merged = durable(merge_runs(docs, doc_id, text, keep))
    rows = _narrow(docs, doc_id, text).withColumn("_salt", F.xxhash64("_id"))
    return attach(rows, merged, KEY, "group_size", "_salt").select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each text.

    Rows meet their digest's entry by identifier and digest together, so a large group of copies spreads out.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    whole, own = F.coalesce(F.col(f"_row.`{text}`"), F.lit("")), F.col(f"_row.`{doc_id}`").cast("long")
    rows = docs.select(row).select("_row", F.isnull(own).alias("_none"), F.coalesce(own, F.lit(0)).alias("_id"), F.unhex(F.sha2(whole, 256)).alias("_sha"), F.octet_length(whole).alias("_len"), F.xxhash64(whole).alias("_xx"))
    stay = merge_runs(docs, doc_id, text, keep).select(F.isnull("keep_id").alias("_none"), F.coalesce("keep_id", F.lit(0)).alias("_id"), *KEY)
    # rows that agree in identifier and text are thinned out before they are shuffled
    return rows.dropDuplicates(["_none", "_id", *KEY]).join(stay, ["_none", "_id", *KEY], "left_semi").select("_row.*")

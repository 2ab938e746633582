"""Mixing sources to target weights by Poisson replication.

A source with weight w and b bytes of the corpus's B must be repeated r = w * B / b times on average. Each document
draws its number of copies by inverting the Poisson distribution with mean r at a number that a hash of seed and
identifier gives, so a lost task draws the same again. Copies are exploded and dealt out by a second hash.

The distribution is tabulated once for each source, in logarithms, so large means don't underflow. The table of
sources is broadcast only where it is counted to have at most BROADCAST_SOURCES rows; beyond that it is joined by
salted keys.

Defined results: null text has no bytes, texts of any length are carried whole; a null source is a source of its own; a null identifier hashes as the empty
string. Rows that share an identifier draw the same count. Sources whose texts are all empty are kept once. Sources
that given weights don't name have weight 0 and go. An empty table gives an empty result. Extra columns are
returned, but for those named like the two that `mix` adds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_SOURCES = 10_000
#: Parts of a source in the join beyond that number of sources.
SALTS = 64
#: Without given weights, a source's weight is in proportion to its bytes to this power.
TEMPERATURE = 0.7
SEED = 20


def _uniform(*parts: Column) -> Column:
    """52 bits of MD5 as a number from 0 to 1, both excluded."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def rates(docs: DataFrame, source: str, text: str, weights: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """_source, _rate, and _cdf, the distribution function at 0, 1, 2, ..."""
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).alias("_bytes"))
    if weights is None:
        sizes = sizes.withColumn("_w", F.pow(F.col("_bytes").cast("double"), F.lit(float(temperature))))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        sizes = sizes.withColumn("_w", F.coalesce(F.try_element_at(given, F.col("_source").cast("string")).cast("double"), F.lit(0.0)))
    whole = sizes.agg(F.sum("_w").alias("_all_w"), F.sum("_bytes").alias("_all_bytes"))
    each = sizes.join(F.broadcast(whole))  # one row
    rate = F.when(F.col("_bytes") > 0, F.col("_w") / F.col("_all_w") * (F.col("_all_bytes") / F.col("_bytes"))).otherwise(F.when(F.col("_w") > 0, 1.0).otherwise(0.0) if weights is not None else F.lit(1.0))
    each = each.select("_source", F.coalesce(rate, F.lit(0.0)).alias("_rate"))
    cdf = """aggregate(sequence(1, cast(_rate + 12 * sqrt(_rate) + 40 as int)),
        named_struct('lp', -_rate, 'cum', exp(-_rate), 'out', array(exp(-_rate))),
        (a, k) -> named_struct('lp', a.lp + ln(_rate) - ln(k), 'cum', a.cum + exp(a.lp + ln(_rate) - ln(k)), 'out', concat(a.out, array(a.cum + exp(a.lp + ln(_rate) - ln(k))))),
        a -> a.out)"""
    return each.withColumn("_cdf", F.when(F.col("_rate") > 0, F.expr(cdf)).otherwise(F.array().cast("array<double>")))


def _copies(docs: DataFrame, weights: Mapping[str, float] | None, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """_row, _copy and _key; partitions hold hash-dealt copies in order of _key."""
    table = rates(docs, source, text, weights, temperature)
    ident = F.coalesce(F.col(f"_row.`{doc_id}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_u", _uniform(F.lit(str(seed)), ident))
    if table.count() <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(table), F.col(f"_row.`{source}`").eqNullSafe(F.col("_source")))
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int")).join(salted, F.col(f"_row.`{source}`").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_salt")))
    n = F.expr("size(filter(_cdf, c -> c <= _u))")
    copies = met.select("_row", n.alias("_n")).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), ident, F.col("_copy").cast("string"))), 17, 15), 16, 10).cast("long")
    return copies.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, **more) -> DataFrame:
    """The columns of docs, then copy (from 0) and order_key; columns of docs that bear one of these two names are left out."""
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("copy", "order_key")]
    return _copies(docs, weights, **more).select(*kept, F.col("_copy").cast("long").alias("copy"), F.col("_key").alias("order_key"))


def repeat(docs: DataFrame, weights: Mapping[str, float] | None = None, **more) -> DataFrame:
    """As mix, with the columns of docs alone, whatever their names."""
    return _copies(docs, weights, **more).select("_row.*")

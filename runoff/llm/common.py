"""What the operators of this subpackage share: durable cuts of lineage and a join that no hot key can tilt."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one part in so many of all rows is hot; there are fewer such keys than this number.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where a local master names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="runoff-checkpoint-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut; lost executors don't matter to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def round_end(df: DataFrame) -> DataFrame:
    """durable(df) for loops: a checkpoint keeps its plan's estimated size, whose digits joins multiply each round, so
    the rows are handed on without an estimate."""
    kept = durable(df)._jdf
    return DataFrame(kept.sparkSession().createDataFrame(kept.javaRDD(), kept.schema()), df.sparkSession)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that new_path named, once nothing reads it any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def meet(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to groups, which has one row for each key and the key's number of rows in `size`; `total` is their sum.

    Fewer than HOT_PARTS keys hold more than 1/HOT_PARTS of all rows. Those groups are broadcast and their rows stay
    where they are; only the others' rows are shuffled. rows are read twice.
    """
    hot, cold = groups.where(F.col(size) * HOT_PARTS > total), groups.where(F.col(size) * HOT_PARTS <= total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, salt: str) -> DataFrame:
    """rows left-joined to groups, which has one row for each key and the key's number of rows in `size`.

    Keys that hold more than 1/HOT_PARTS of all rows number fewer than HOT_PARTS, so those groups are
    broadcast. Their rows then leave the shuffled join's hot partition: the last key is swapped for
    `salt`, a bigint that differs from row to row.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * HOT_PARTS > total).select(*keys, F.struct(*values).alias("_hot"))
    spread = rows.join(F.broadcast(hot), list(keys), "left")
    is_hot = F.col("_hot").isNotNull()
    left = spread.withColumn("_k", F.when(is_hot, F.col(salt)).otherwise(F.col(keys[-1])))
    right = groups.where(F.col(size) * HOT_PARTS <= total).select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.struct(*values).alias("_cold"))
    on = [F.col(k) == F.col(f"_g_{k}") for k in keys[:-1]] + [F.col("_k") == F.col(f"_g_{keys[-1]}")]
    joined = left.join(right, on, "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])

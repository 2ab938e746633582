"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product. Vectors are hashed apart by ranges of their norm, in each of which the largest is at most
2**0.25 times the smallest. One more component, sqrt(M**2 - |x|**2) with M the largest norm of the range, and 0 for a
query, which is scaled to the norm M, makes the order by inner product the order by distance, which Gaussian
projections, shifted and cut into steps of `WIDTH` times the range's root mean square norm, hash: HASHES of them make a
bucket, in each of TABLES tables. In every range a query visits its own bucket and the PROBES - 1 perturbed ones that
are likeliest to hold a neighbour: sets of ranks in order of expected squared distance to the cell walls, applied to the
query's own ranking of its walls. A range of no more nodes than a query has probes there is visited whole. Candidates of
all tables and ranges, and the query's own node, are merged and ranked by the exact inner product in double precision of
the vectors as given. Queries for which that leaves less than k neighbours, where there are more, are ranked against all
vectors.

Equal vectors are one node with its K + 1 smallest identifiers, so copies cost one candidate. Cells are cut into blocks
of at most BLOCK vectors and BLOCK queries, a task multiplies matrices and gives back the best K + 1 for each query,
never the pairs. Only three numbers of each range, its M, mean square and count, come to the driver.

Defined results: rows whose identifier or vector is null, whose vector is zero, holds a null or non-finite component or
isn't as long as most vectors are, take no part. Equal scores go by the smaller identifier. A query's own identifier is
never its neighbour; rows that share an identifier count once; very long vectors are vectors like any other. Empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runoff.llm.common import attach, durable

K, TABLES, HASHES, WIDTH, PROBES = 20, 4, 4, 1.5, 48
#: Vectors and queries of a cell that one task multiplies at a time, and rows that a task takes on average.
BLOCK, TASK = 4096, 16_384
RANKED = "node binary, found array<long>, score array<double>"


def probe_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets as ranks of the 2 * hashes walls, nearest first, in order of expected success.

    The expected squares are those of order statistics of uniform distances to the nearer walls; of a hash's two walls
    (ranks r and 2 * hashes - 1 - r) a set crosses one at most.
    """
    m = hashes
    rising = [(j * (j + 1)) / (4.0 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost = rising + [1.0 - (2 * m + 1 - j) / (m + 1.0) + rising[2 * m - j] for j in range(m + 1, 2 * m + 1)]
    found: list[tuple[int, ...]] = [()]
    waiting = [(cost[0], (0,))]
    while waiting and len(found) < probes:
        total, ranks = heapq.heappop(waiting)
        if all(2 * m - 1 - r not in ranks for r in ranks):
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(waiting, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(waiting, (total + cost[last + 1], (*ranks, last + 1)))
    return found


class Hashes:
    def __init__(self, dim: int, top: float, scale: float, tables: int, hashes: int, width: float, probes: int, seed: int = 3) -> None:
        """Of a range of norms: top is its largest, scale its root mean square."""
        rng = np.random.default_rng(seed)
        self.top, self.step = top, width * scale
        self.lines = rng.normal(size=(tables, dim + 1, hashes))
        self.shift = rng.uniform(0, self.step, (tables, 1, hashes))
        self.mixer = rng.integers(1, 2**62, hashes, dtype=np.int64) * 2 + 1
        self.order = probe_order(hashes, probes)

    def _cells(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return (np.concatenate([x, extra[:, None]], 1) @ self.lines + self.shift) / self.step

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """[table, vector]"""
        extra = np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))
        return (np.floor(self._cells(x, extra)).astype(np.int64) * self.mixer).sum(2)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """[table, query, probe]"""
        cells = self._cells(x * (self.top / np.sqrt((x**2).sum(1)))[:, None], np.zeros(len(x)))
        low = np.floor(cells)
        down = cells - low  # distance to the lower wall
        walls = np.concatenate([down, 1 - down], 2)
        ranked = np.argsort(walls, axis=2, kind="stable")
        change = np.concatenate([-self.mixer, self.mixer])[ranked]
        base = (low.astype(np.int64) * self.mixer).sum(2)
        out = [base + sum((change[:, :, r] for r in ranks), np.zeros_like(base)) for ranks in self.order]
        return np.stack(out, 2)


def _matrix(column: pa.Array | pd.Series, dtype: str) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column.tolist()
    return np.frombuffer(b"".join(values), dtype).astype(np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def norm_range(square: np.ndarray) -> np.ndarray:
    """The range of each squared norm, by powers of sqrt(2); a table of unit vectors lies within one."""
    return np.clip(np.floor(2 * np.log2(square) + 0.5), -4000, 4000).astype(np.int32)


def clean_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str, int]:
    """vec_id, node, vec (the components' bytes); the bytes' type and the dimension."""
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    e = F.col("e")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "float" else "array<double>").alias("e"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    square = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite).withColumn("sq", square).where("sq > 0")
    most = rows.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = most["d"] if most else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column("e").flatten()).astype(dtype).reshape(batch.num_rows, -1) + 0  # no negative zeros
            raw = [r.tobytes() for r in flat]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "node", "vec"])

    packed = rows.where(F.size("e") == dim).select("vec_id", "e").mapInArrow(pack, "vec_id long, node binary, vec binary")
    return durable(packed), dtype, dim


def _whole(nodes: DataFrame) -> DataFrame:
    """nodes as the vectors of a single cell."""
    return nodes.select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"), "node", "vec", "ids")


def _ranked(stored: DataFrame, asked: DataFrame, k: int, dtype: str) -> DataFrame:
    """node, found, score: for each query that shares a cell with vectors, a task's k + 1 best of them."""
    cell = ["t", "bucket"]
    sized = stored.groupBy(*cell).agg(F.count(F.lit(1)).alias("nv")).join(asked.groupBy(*cell).agg(F.count(F.lit(1)).alias("nq")), cell)
    sized = durable(sized.select(*cell, F.ceil(F.col("nv") / BLOCK).alias("bv"), F.ceil(F.col("nq") / BLOCK).alias("bq"), F.col("nv"), F.col("nq")))
    work = sized.agg(F.sum(F.col("nv") * F.col("bq") + F.col("nq") * F.col("bv"))).first()[0] or 0
    tasks = max(1, -(-work // TASK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    left = stored.join(sized, cell).select(*cell, own("bv").alias("v"), every("bq").alias("q"), F.lit(False).alias("asks"), "node", "vec", "ids")
    right = asked.join(sized, cell).select(*cell, every("bv").alias("v"), own("bq").alias("q"), F.lit(True).alias("asks"), "node", "vec", F.array().cast("array<long>").alias("ids"))
    dealt = left.unionByName(right).withColumn("task", F.pmod(F.xxhash64(*cell, "v", "q"), F.lit(tasks)))

    def rank(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for _, part in rows.groupby(["t", "bucket", "v", "q"], sort=True):
            asks = part["asks"].to_numpy(bool)
            if asks.all() or not asks.any():
                continue
            there, here = part[~asks], part[asks]
            x, names = _matrix(there["vec"], dtype), there["ids"].tolist()
            y, queries = _matrix(here["vec"], dtype), here["node"].tolist()
            slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((x**2).sum(1).max())
            for at in range(0, len(y), 256):
                near = y[at : at + 256] @ x.T
                least = np.partition(near, max(len(x) - k - 1, 0), axis=1)[:, max(len(x) - k - 1, 0)]
                for q in range(len(near)):
                    # all that tie with the last of k + 1, or differ by what rounding may have reordered
                    chosen = np.flatnonzero(near[q] >= least[q] - slack * np.sqrt((y[at + q] ** 2).sum()))
                    exact = (x[chosen] * y[at + q]).sum(1)
                    lists = [names[c] for c in chosen]
                    found, score = np.concatenate(lists), np.repeat(exact, [len(i) for i in lists])
                    name = queries[at + q]
                    if name in best:
                        found, score = np.concatenate([best[name][0], found]), np.concatenate([best[name][1], score])
                    best[name] = _first(found, score, k + 1)
        return pd.DataFrame({"node": list(best), "found": [b[0] for b in best.values()], "score": [b[1] for b in best.values()]})

    return dealt.groupBy("task").applyInPandas(rank, RANKED)


def search(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row that `is_query`, a condition on vec_id, picks."""
    rows, dtype, dim = clean_vectors(vectors, vec_id, embedding)
    few = rows.select("node", "vec_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = few.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    each = rows.groupBy("node").agg(F.first("vec").alias("vec"), F.max(is_query).alias("asks"))
    nodes = durable(each.join(ids, "node"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            square = (_matrix(batch.column("vec"), dtype) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(norm_range(square)), pa.array(square)], ["range", "sq"])

    stats = nodes.select("vec").mapInArrow(measure, "range int, sq double").groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("sq").alias("top"), F.avg("sq").alias("mean"))
    ranges = [(r["range"], r["n"], float(r["top"]) ** 0.5, float(r["mean"]) ** 0.5) for r in stats.orderBy("range").collect()]
    small = tables * probes  # nodes of a range that is visited whole

    def made() -> list[tuple[int, int, Hashes | None]]:
        """A range, its first table and its hashes, None if it is visited whole."""
        return [(r, at * tables, Hashes(dim, top, scale, tables, hashes, width, probes) if n > small else None) for at, (r, n, top, scale) in enumerate(ranges)]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = made()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("vec"), dtype)
                own = norm_range((x**2).sum(1))
                for r, t0, h in hashed:
                    if not (mine := own == r).any():
                        continue
                    here = part.filter(pa.array(mine))
                    b = h.buckets(x[mine]) if h else np.zeros((1, here.num_rows), np.int64)
                    for t in range(len(b)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(here.num_rows, t0 + t, np.int32)), pa.array(b[t]), here.column("node"), here.column("vec"), here.column("ids")], ["t", "bucket", "node", "vec", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = made()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column("vec"), dtype)
                for _, t0, h in hashed:
                    b = h.probes(x) if h else np.zeros((1, part.num_rows, 1), np.int64)
                    for t in range(len(b)):
                        for p in range(b.shape[2]):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, t0 + t, np.int32)), pa.array(b[t, :, p]), part.column("node"), part.column("vec")], ["t", "bucket", "node", "vec"])

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            square, lists = (_matrix(batch.column("vec"), dtype) ** 2).sum(1), batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(lists, pa.list_(pa.int64())), pa.array([[s] * len(i) for s, i in zip(square, lists, strict=True)], pa.list_(pa.float64()))], ["node", "found", "score"])

    stored = nodes.select("node", "vec", "ids").mapInArrow(put, "t int, bucket long, node binary, vec binary, ids array<long>")
    asking = nodes.where("asks")
    asked = asking.select("node", "vec").mapInArrow(ask, "t int, bucket long, node binary, vec binary").dropDuplicates(["t", "bucket", "node"])
    parts = max(1, -(-asking.count() // 2048))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, part in rows.groupby("node", sort=True):
            found, score = _first(np.concatenate(part["found"].tolist()), np.concatenate(part["score"].tolist()), k + 1)
            out.append((name, found, score))
        return pd.DataFrame(out, columns=["node", "found", "score"])

    merge_all = lambda df: durable(df.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts))).groupBy("part").applyInPandas(merge, RANKED))
    merged = merge_all(_ranked(stored, asked, k, dtype).unionByName(asking.select("node", "vec", "ids").mapInArrow(itself, RANKED)))
    short = merged.where(F.size("found") < min(k + 1, rows.select("vec_id").distinct().count())).select("node")
    if not short.isEmpty():
        merged = merge_all(merged.unionByName(_ranked(_whole(nodes), _whole(nodes.join(short, "node")).drop("ids"), k, dtype)))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "node").distinct()
    sizes = queries.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    keyed = lambda df, *more: df.select(F.substring("node", 1, 8).alias("head"), F.conv(F.hex(F.substring("node", 9, 8)), 16, -10).cast("long").alias("tail"), *more)
    results = durable(keyed(merged.join(sizes, "node"), "n", F.arrays_zip("found", "score").alias("near")))
    met = attach(keyed(queries, "query_id", F.xxhash64("query_id").alias("salt")), results, ["head", "tail"], "n", "salt")
    others = F.slice(F.filter("near", lambda x: x["found"] != F.col("query_id")), 1, k)
    return met.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.found").alias("vec_id"), F.col("x.score").alias("score"))


def _first(found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best different identifiers: highest score, then smallest identifier."""
    order = np.lexsort((found, -score))
    found, score = found[order], score[order]
    _, at = np.unique(found, return_index=True)
    at = np.sort(at)[:k]
    return found[at], score[at]

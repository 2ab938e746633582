"""N-gram Jaccard self-join: MinHash banding, then exact verification on whole n-gram sets.

1. One pass makes each text's set of word n-grams, a 128-bit digest of the set, and MinHash bands; `choose_bands` picks
   bands and rows for the target recall at the threshold.
2. Texts with equal sets become one node before anything is shuffled, so a group of copies costs one row a task.
3. Band hashes are shuffled. Each node of a bucket is tied to the bucket's smallest node, never to all of them, and
   components of these ties are the candidate groups.
4. The texts of candidate groups are shuffled once, and every pair of a group is verified on its full n-gram sets
   inside a task, by products of membership matrices. Groups over BLOCK nodes or BLOCK_BYTES are cut into blocks, and
   pairs of blocks are verified apart. Tasks give back each node's links and a spanning forest of them, not the pairs.

Results: every document with class_id, the smallest identifier that links of the threshold lead to, set_id, the
smallest identifier with an equal set, set_size, and n_links, the number of other documents at the threshold or over.

Defined results: words are what white space parts in the lower-cased text; a text of fewer than n words has one
n-gram, all of them; texts without words (null, empty, blank) have equal, empty sets and are one class. A null
identifier ranks over every other; class_id is null where all are null. Rows repeated in full count one by one. Empty
tables give empty results. Extra columns are ignored by `near_classes` and returned by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.llm.common import attach, durable, meet
from runoff.llm.components import components, contract
from runoff.llm.words import CACHE_WORDS, code_words, give_back, slices

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Most MinHash values that choose_bands may spend.
HASHES = 320
#: Nodes of a candidate group, and bytes of their texts, that are verified among themselves at a time.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Bytes of text that are verified in one call on average, and most partitions that calls are dealt to.
TASK_BYTES, MOST_PARTS = 1 << 20, 20_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance meetings, whose bands reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def ngram_sets(texts: pa.Array, n: int, known: _WordHash) -> list[np.ndarray]:
    """Each text's sorted set of 64-bit n-gram hashes."""
    coded = code_words(pc.utf8_lower(pc.fill_null(texts, "")))
    words = np.array([known[w] for w in coded.distinct], np.uint64)[coded.codes] if len(coded.codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words), np.uint64)
        for k in range(n):  # n-gram at i: words i to i + n - 1
            shifted = np.zeros(len(words), np.uint64)
            shifted[: max(len(words) - k, 0)] = words[k:]
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + shifted
        rolled = _mixed(rolled, n)
        out = []
        for a, b in zip(coded.bounds[:-1], coded.bounds[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + w
                out.append(_mixed(np.array([h]), n + 1))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


class Bands:
    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.plus = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each band."""
        least = np.full(len(self.times), 2**32 - 1, np.uint32)
        low = (grams >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(low), 1024):
            np.minimum(least, (low[None, at : at + 1024] * self.times + self.plus).min(1), out=least)
        folded = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            for row in least.reshape(self.bands, self.rows).astype(np.uint64).T:
                folded = _mixed(folded + row, 7)
        return folded


def signatures(docs: DataFrame, n: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """_id, _md and _size (of the text), _node (digest of the set), _bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, banded = _WordHash(), Bands(bands, rows)
        for batch in batches:
            for part in slices(batch):
                sets = ngram_sets(part.column("text"), n, known)
                keys = [banded(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_md"), part.column("_size"), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["_id", "_md", "_size", "_node", "_bands"])

    return _ready(docs, doc_id, text).mapInArrow(run, "_id long, _md binary, _size long, _node binary, _bands array<long>")


def _ready(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.unhex(F.md5(whole)).alias("_md"), F.octet_length(whole).cast("long").alias("_size"), whole.alias("text"))


def smallest_linked(hit: np.ndarray) -> np.ndarray:
    """The smallest node that links lead to, for each node of a symmetric matrix of links."""
    label = np.arange(len(hit))
    while True:
        least = np.minimum(label, np.where(hit, label, len(hit)).min(1, initial=len(hit)))
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _verify(threshold: float, n: int):
    def linked(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Which pairs of rows and columns are at the threshold or over."""
        sizes = np.array([len(s) for s in sets], float)
        both = np.unique(np.concatenate([rows, columns]))
        grams, inverse, counts = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1  # n-grams of one text alone meet nothing
        keep = (counts > 1)[inverse]
        owner = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])[keep]
        column = shared[inverse[keep]]
        place = {int(i): k for k, i in enumerate(both)}
        r, c = np.array([place[int(i)] for i in rows]), np.array([place[int(i)] for i in columns])
        inter = np.zeros((len(rows), len(columns)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        step = max(64, (1 << 22) // len(both))
        for at in range(0, int(counts[counts > 1].size), step):
            a, b = np.searchsorted(column, [at, at + step])
            member = np.zeros((len(both), step), np.float32)
            member[owner[a:b], column[a:b] - at] = 1
            inter += member[r] @ member[c].T
        union = sizes[rows][:, None] + sizes[columns][None, :] - inter
        return inter / np.maximum(union, 1) >= threshold

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["_group", "_a", "_b", "_node"]).sort_values(["_group", "_a", "_b", "_node"], ignore_index=True)
        known, out = _WordHash(), []
        for (_, a, b), part in rows.groupby(["_group", "_a", "_b"], sort=False):
            sets = ngram_sets(pa.array(part["text"], pa.string()), n, known)
            nodes, weight, block = part["_node"].tolist(), part["_n"].to_numpy(), part["_block"].to_numpy()
            left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
            if not len(left) or not len(right):
                continue
            hit = linked(sets, left, right)
            found = np.zeros(len(nodes), np.int64)
            if a == b:
                np.fill_diagonal(hit, False)
                found[left] = hit @ weight
                root = smallest_linked(hit)
            else:
                found[left], found[right] = hit @ weight[right], weight[left] @ hit
                whole = np.zeros((len(nodes), len(nodes)), bool)
                whole[np.ix_(left, right)] = hit
                root = smallest_linked(whole | whole.T)
            out.append(pd.DataFrame({"_node": nodes, "_links": found, "_root": [nodes[i] for i in root]}))
        give_back()
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"_node": [], "_links": [], "_root": []})

    return run


def node_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _md, _node), and nodes (_node, set_size, set_id, class_id, n_links, _keep: the row that stands for the class)."""
    bands, width = choose_bands(threshold, recall)
    rows = durable(signatures(docs, n, bands, width, doc_id, text))
    least = F.min(F.struct(F.isnull("_id").alias("none"), "_id", "_md", "_size", "_bands"))
    nodes = durable(rows.groupBy("_node").agg(least.alias("r"), F.count(F.lit(1)).alias("set_size")).select("_node", "set_size", F.col("r._id").alias("set_id"), F.col("r._md").alias("_md"), F.col("r._size").alias("_size"), F.col("r._bands").alias("_bands")))
    ties = nodes.select("_node", F.explode("_bands").alias("band"))
    first = durable(ties.groupBy("band").agg(F.min("_node").alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    met = meet(ties, first, "band", "c", first.agg(F.sum("c")).first()[0] or 0)
    groups = components(contract(met.where("_node <> v").select(F.col("_node").alias("u"), "v")))
    kept = nodes.select("_node", "set_size", "set_id", "_md", "_size")
    groups = durable(groups.select(F.col("node").alias("_node"), F.col("label").alias("_group")).join(kept, "_node"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("_size") / BLOCK_BYTES)).alias("blocks")
    sizes = groups.groupBy("_group").agg(F.count(F.lit(1)).alias("m"), blocks)
    dealt = meet(groups, sizes, "_group", "m", groups.count()).withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("_block")).alias("a"), F.greatest(k, F.col("_block")).alias("b")))
    work = dealt.select("_node", F.col("set_size").alias("_n"), "set_id", "_md", "_size", "_group", "_block", F.explode(pairs).alias("p"))
    work = durable(work.select("_node", "_n", F.isnull("set_id").alias("_none"), F.coalesce("set_id", F.lit(0)).alias("_id"), "_md", "_size", "_group", "_block", F.col("p.a").alias("_a"), F.col("p.b").alias("_b")))
    tasks = max(1, -(-(work.agg(F.sum("_size")).first()[0] or 0) // TASK_BYTES))
    texts = _ready(docs, doc_id, text).withColumn("_none", F.isnull("_id")).withColumn("_id", F.coalesce("_id", F.lit(0))).drop("_size")
    full = work.join(texts, ["_none", "_id", "_md"]).withColumn("_task", F.pmod(F.xxhash64("_group", "_a", "_b"), F.lit(tasks)))
    full = full.select("_task", "_node", "_n", "_group", "_block", "_a", "_b", "text").repartition(min(tasks, MOST_PARTS), "_task")  # few bytes are much work, so they aren't coalesced
    verified = durable(full.groupBy("_task").applyInPandas(_verify(threshold, n), "_node binary, _links long, _root binary"))
    links = verified.groupBy("_node").agg(F.sum("_links").alias("_links"))
    classes = components(verified.where("_node <> _root").select(F.col("_node").alias("u"), F.col("_root").alias("v")))
    classed = durable(kept.drop("_size").join(links, "_node", "left").join(classes.select(F.col("node").alias("_node"), "label"), "_node", "left").withColumn("_class", F.coalesce("label", "_node")))
    best = classed.groupBy("_class").agg(F.min(F.struct(F.isnull("set_id").alias("none"), "set_id", "_md")).alias("k"), F.count(F.lit(1)).alias("m"))
    done = meet(classed, best, "_class", "m", classed.count()).select("_node", "set_size", "set_id", F.col("k.set_id").alias("class_id"), (F.coalesce("_links", F.lit(0)) + F.col("set_size") - 1).alias("n_links"), F.col("k._md").alias("_keep"))
    return rows.select("_id", "_md", "_node"), durable(done)


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, set_id, set_size, n_links for every row."""
    rows, nodes = node_classes(docs, n, threshold, recall, doc_id, text)
    rows = rows.select("_id", F.substring("_node", 1, 8).alias("_head"), F.conv(F.hex(F.substring("_node", 9, 8)), 16, -10).cast("long").alias("_tail"), F.xxhash64("_id", "_md").alias("_salt"))
    nodes = nodes.select(F.substring("_node", 1, 8).alias("_head"), F.conv(F.hex(F.substring("_node", 9, 8)), 16, -10).cast("long").alias("_tail"), "set_size", "set_id", "class_id", "n_links")
    return attach(rows, nodes, ["_head", "_tail"], "set_size", "_salt").select(F.col("_id").alias("doc_id"), "class_id", "set_id", "set_size", "n_links")


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their class, with all their columns."""
    _, nodes = node_classes(docs, n, threshold, recall, doc_id, text)
    stay = nodes.select(F.isnull("class_id").alias("_none"), F.coalesce("class_id", F.lit(0)).alias("_id"), F.col("_keep").alias("_md")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = F.col(f"_row.`{doc_id}`").cast("long")
    rows = docs.select(row).select("_row", F.isnull(own).alias("_none"), F.coalesce(own, F.lit(0)).alias("_id"), F.unhex(F.md5(F.coalesce(F.col(f"_row.`{text}`"), F.lit("")))).alias("_md"))
    # rows that agree in identifier and text are thinned out before they are shuffled
    return rows.dropDuplicates(["_none", "_id", "_md"]).join(stay, ["_none", "_id", "_md"], "left_semi").select("_row.*")

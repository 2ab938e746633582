"""Token counts of documents in flat token files that have no index.

A flat file is identifiers one after the other, each document closed by a separator, and may be of any size. Tasks
read byte ranges of it, blocks cut at any place, and search each block for separators as one vector. A prefix scan
over the blocks carries the number of tokens, the number of separators and the place of the last separator, which puts
documents together that lie across blocks. A list of files looks small to the planner whatever they hold, so joins of
what was read from them ask for a merge, never a broadcast. The scan has two levels, blocks within spans of SPAN blocks and spans within
the file, and takes three numbers of each block, so one huge file spreads over as many tasks as it has spans; positions
meet their block's sums after it. Blocks hold at most BLOCK tokens, and a task holds one at a time.

`write_flat_files` writes such files through Spark's own committed writer, and beside each file of tokens one of
identifiers in the same order, NAME bytes a document, which only tells whose counts they are. Ranges are read by
pyarrow's file systems (local paths, HDFS and the object stores that it knows), whatever wrote the files.

Defined results: tokens after the last separator of a file are one more document, `closed` false. Empty documents
count 0, and null texts are empty; texts of any length are whole documents. Rows repeated in full count one by one, a
null identifier stays null. Empty files and tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runoff.llm.common import durable
from runoff.llm.tokens import default_path, encode, encoder
from runoff.llm.words import slices

#: The vocabulary's end-of-text identifier, and the width of its identifiers in a file.
SEPARATOR, DTYPE = 49407, "<u2"
#: Tokens in a block, and blocks in a span.
BLOCK, SPAN = 1 << 19, 1024
#: Bytes of files that a task reads on average.
TASK_BYTES = 32 << 20
#: Bytes of a document in a file of identifiers: whether it has one, the identifier, and what ends a row.
NAME = 1 + 8 + np.dtype(DTYPE).itemsize
TOKENS, NAMES = 0, 1


def write_flat_files(docs: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """One flat file for each partition of docs under root/kind=0, and its documents' identifiers under root/kind=1.

    The text writer ends each row by bytes of one's choice, here the separator, and so makes a flat file of rows that
    are the documents' identifiers. Special strings in a text are ordinary text, so no document holds a separator.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = encoder(path, True), 0
        for batch in batches:
            for part in slices(batch):
                ids, bounds = encode(part.column("text"), words)
                flat, width = ids.astype(DTYPE).tobytes(), np.dtype(DTYPE).itemsize
                names = part.column("doc_id")
                known = np.asarray(names.is_valid())
                label = np.zeros((len(names), NAME - width), np.uint8)
                label[:, 0] = known
                label[:, 1:] = np.asarray(names.fill_null(0)).astype("<i8").view(np.uint8).reshape(-1, 8)
                values = [flat[a * width : b * width] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] + [r.tobytes() for r in label]
                place = np.arange(done, done + len(names))
                done += len(names)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([TOKENS, NAMES], np.int32), len(names))), pa.array(np.tile(place, 2)), pa.array(values, pa.binary())], ["kind", "place", "value"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "kind int, place long, value binary")
    ordered = rows.sortWithinPartitions("kind", "place").select(F.col("value").cast("string").alias("value"), "kind")
    end = SEPARATOR.to_bytes(np.dtype(DTYPE).itemsize, "little").decode("latin-1")
    ordered.write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", end).option("compression", "none").option("maxRecordsPerFile", 0).text(root)


def _opened(uri: str) -> pa.NativeFile:
    place = urlparse(uri)
    if place.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem().open_input_file(place.path)
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read_ranges(spark: SparkSession, path: str, step: int) -> DataFrame:
    """file_id (the file's path), number, payload: the files at path in ranges of `step` bytes, of which a task reads its own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    tasks = max(1, -(-(files.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    ranges = files.select(F.col("path").alias("file_id"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("number"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, sizes = (batch.column(c).to_pylist() for c in ("file_id", "number", "length"))
            for name, number, size in zip(names, numbers, sizes, strict=True):
                with _opened(name) as file:
                    raw = file.read_at(min(step, size - number * step), number * step)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([raw], pa.binary())], ["file_id", "number", "payload"])

    return ranges.repartition(tasks, "file_id", "number").mapInArrow(read, "file_id string, number long, payload binary")


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = DTYPE) -> DataFrame:
    """file_id (the file's path), number, payload of the flat binary files at path."""
    return read_ranges(spark, path, block * np.dtype(dtype).itemsize)


def _sums(found: DataFrame, span: int) -> DataFrame:
    """file_id, number, and what came before each block: base tokens, doc0 separators, open (after the last separator); whether it is the last."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("file_id", "span").orderBy("number")
    blocks = found.select("file_id", "number", F.expr(f"number div {span}").alias("span"), "n", F.size("at").cast("long").alias("k"), (F.try_element_at("at", F.lit(-1)) + 1).alias("after"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before(here)), F.lit(0))).withColumn("doc0", F.coalesce(F.sum("k").over(before(here)), F.lit(0)))
    blocks = blocks.withColumn("open", F.max(F.col("base") + F.col("after")).over(before(here))).withColumn("last", F.lead(F.lit(1)).over(here).isNull())
    spans = blocks.groupBy("file_id", "span").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.col("base") + F.col("after")).alias("after"))
    there = Window.partitionBy("file_id").orderBy("span")
    spans = spans.select("file_id", "span", "after", F.coalesce(F.sum("n").over(before(there)), F.lit(0)).alias("base_"), F.coalesce(F.sum("k").over(before(there)), F.lit(0)).alias("doc_"), F.lead(F.lit(1)).over(there).isNull().alias("last_"))
    spans = spans.withColumn("open_", F.max(F.col("base_") + F.col("after")).over(before(there)))
    both = blocks.drop("after").join(spans.drop("after").hint("merge"), ["file_id", "span"])
    return both.select("file_id", "number", (F.col("base") + F.col("base_")).alias("base"), (F.col("doc0") + F.col("doc_")).alias("doc0"), F.coalesce(F.col("open") + F.col("base_"), "open_", F.lit(0)).alias("open"), (F.col("last") & F.col("last_")).alias("last"))


def scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE, span: int = SPAN) -> DataFrame:
    """file_id, doc_no (from 0), start, n_tokens, closed: every document of the files whose blocks (file_id, number, payload) are given."""
    width = np.dtype(dtype).itemsize

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("payload")[i].as_buffer()
                ids = np.frombuffer(raw, dtype, count=raw.size // width)
                at = np.flatnonzero(ids == separator).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("file_id").slice(i, 1), batch.column("number").slice(i, 1), pa.array([len(ids)], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["file_id", "number", "n", "at"])

    kind = dict(blocks.dtypes)["file_id"]
    found = durable(blocks.select("file_id", F.col("number").cast("long").alias("number"), "payload").mapInArrow(search, f"file_id {kind}, number long, n long, at array<long>"))
    carried = found.join(_sums(found, span).hint("merge"), ["file_id", "number"])
    ends = """transform(at, (p, i) -> named_struct('doc_no', doc0 + i, 'start', if(i = 0, open, base + element_at(at, i) + 1), 'end', base + p, 'closed', true))"""
    tail = "named_struct('doc_no', doc0 + size(at), 'start', if(size(at) > 0, base + try_element_at(at, -1) + 1, open), 'end', base + n, 'closed', false)"
    docs = carried.select("file_id", F.explode(F.expr(f"if(last and if(size(at) > 0, base + try_element_at(at, -1) + 1, open) < base + n, concat({ends}, array({tail})), {ends})")).alias("d"))
    return docs.select("file_id", "d.doc_no", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.closed")


def read_names(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """file_id, doc_no, doc_id of files of identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label = np.frombuffer(batch.column("payload")[i].as_buffer(), np.uint8).reshape(-1, NAME)
                ids = np.ascontiguousarray(label[:, 1:9]).view("<i8").ravel()
                first = batch.column("number")[i].as_py() * block
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column("file_id")[i].as_py(), np.int32)), pa.array(np.arange(first, first + len(ids))), pa.array(ids, mask=label[:, 0] == 0)], ["file_id", "doc_no", "doc_id"])

    return _numbered(read_ranges(spark, path, block * NAME)).mapInArrow(run, "file_id int, doc_no long, doc_id long")


def _numbered(ranges: DataFrame) -> DataFrame:
    """ranges of files that Spark wrote, by the number of the task that wrote them."""
    return ranges.withColumn("file_id", F.regexp_extract("file_id", r"part-(\d+)-[^/]*$", 1).cast("int"))


def count_tokens(docs: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs as flat files under root, scans those, and names each count's document: doc_id, file_id, doc_no, start, n_tokens."""
    spark = docs.sparkSession
    write_flat_files(docs, root, doc_id, text)
    if not any(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where("length > 0").select("path").take(1)):
        return spark.createDataFrame([], "doc_id long, file_id int, doc_no long, start long, n_tokens long")
    counted = scan(_numbered(read_flat_files(spark, f"{root}/kind={TOKENS}")))
    return read_names(spark, f"{root}/kind={NAMES}").join(counted.hint("merge"), ["file_id", "doc_no"]).select("doc_id", "file_id", "doc_no", "start", "n_tokens")

"""Whole texts as coded words, a slice of a batch at a time, so that Python work is done once for each distinct word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are coded at a time; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Entries of a worker's cache; a full cache is emptied, which changes no result.
CACHE_WORDS = 1 << 16


@dataclass
class Words:
    codes: np.ndarray  #: of each word, in order
    bounds: np.ndarray  #: text i has the words bounds[i] to bounds[i + 1]
    distinct: list[str]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def code_words(texts: pa.Array) -> Words:
    """Words are what ASCII white space parts; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    codes, bounds, distinct = np.asarray(coded.indices), np.asarray(lists.offsets).astype(np.int64), coded.dictionary.to_pylist()
    bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
    if "" in distinct:
        real = codes != distinct.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return Words(codes, bounds, distinct)


def give_back() -> None:
    """Returns what Arrow and C's allocator keep of freed memory; a worker lives on between tasks, beside its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of about SLICE_BYTES of text; free memory goes back after the last."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    part = np.cumsum(size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs starts[i] to starts[i] + sizes[i], one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)

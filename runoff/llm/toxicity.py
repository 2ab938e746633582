"""Toxicity scores: boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of lexicon words, whether a second-person word stands near one, and rates of capitals,
punctuation and obfuscation. The lexicon is learned: words and word beginnings that are much commoner in toxic
labelled texts, counted once for each different text. Two lexicons come from two halves of the labelled rows, and
each half's features are made with the other's, so the trees see lexicons as foreign to their rows as later ones are.

Labels are read only from the rows that `trains` admits, and from at most FIT_ROWS of those, picked by hash; at most
LEXICON entries and FIT_ROWS rows of features come to the driver, whatever the size of the table. Scoring is one pass
without a shuffle.

Defined results: null and empty texts get the score of a text without words. Labels other than 0 and 1, and labels of
absent documents, are ignored; a document labelled more than once counts as toxic if any label says so. Where one class
has no training row, every score is the share of toxic rows (0 if there are no rows). Rows that share an identifier are
scored each by its text. Empty tables give empty results; extra columns are ignored, or returned by `keep_clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runoff.llm.boosting import Boosted, fit_boosted, fit_isotonic
from runoff.llm.common import durable
from runoff.llm.words import CACHE_WORDS, code_words, slices

#: Most labelled rows that the model is fitted to, most lexicon entries, and what makes an entry.
FIT_ROWS, LEXICON, LEAST_TEXTS, LEAST_ODDS = 20_000, 4_000, 4, 2.5
#: Lengths of word beginnings that a lexicon may hold.
STEMS = (4, 5, 6)
#: Words between a lexicon word and a second-person word that is near.
NEAR = 5
#: predicted is 1 from this score.
THRESHOLD = 0.3
#: Second-person words (fixed values): English, German, French, Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu toi te ton ta tes vous votre vos tú ti tuyo tus su usted ustedes vosotros".split())
FEATURES = 16
_CORE = re.compile(r"[^\W\d_]+(?:['’\-*@$0-9!][^\W\d_]+)*")
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def trains(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def _entries(word: str) -> tuple[str, ...]:
    """What a word may be found as: itself, itself with look-alike signs undone, its beginnings."""
    found = _CORE.search(word.lower())
    if not found:
        return ()
    core = found.group()
    plain = core.translate(_SIGNS) if not core.isalpha() else core
    return (plain, *(f"{plain[:k]}~" for k in STEMS if len(plain) > k))


class _WordFeatures(dict):
    """word -> (lexicon weight, second person, capitals, letters, punctuation, ! and ?, obfuscated)."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple:
        entries = _entries(word)
        weight = max((self.lexicon.get(e, 0.0) for e in entries), default=0.0)
        letters = sum(map(str.isalpha, word))
        signs = sum(not c.isalnum() for c in word)
        core = word.strip(".,;:!?\"'()[]#$%&*|")
        masked = any(a.isalpha() and b in "0134579@$*!" and c.isalpha() for a, b, c in zip(core, core[1:], core[2:], strict=False))
        value = (weight, bool(entries) and entries[0] in SECOND_PERSON, letters > 1 and word.isupper(), letters, signs, word.count("!") + word.count("?"), masked or signs >= 3)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


def features(texts: pa.Array, known: _WordFeatures) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    coded = code_words(texts)
    n, words, owner = len(texts), coded.counts.astype(float), coded.owner
    of_word = np.array([known[w] for w in coded.distinct], float).reshape(-1, 7)[coded.codes]
    total = lambda v: np.bincount(owner, v, n)
    weight, second = of_word[:, 0], of_word[:, 1] > 0
    hit, strong = weight > 0, weight > 4
    seen = np.concatenate([[0], np.cumsum(second)])
    place = np.arange(len(owner))
    low, high = np.maximum(place - NEAR, coded.bounds[:-1][owner]), np.minimum(place + NEAR + 1, coded.bounds[1:][owner])
    near = hit & (seen[high] > seen[low])
    most = np.zeros(n)
    np.maximum.at(most, owner, weight)
    hits, strongs = total(hit), total(strong)
    different = np.bincount(np.unique(np.stack([owner[hit], coded.codes[hit]]), axis=1)[0], minlength=n) if hit.any() else np.zeros(n)
    per = 1 / np.maximum(words, 1)
    letters = np.maximum(total(of_word[:, 3]), 1)
    return np.stack([
        hits * per, strongs * per, total(weight) * per, most, np.log1p(strongs), np.log1p(hits), different, total(near) * per,
        total(second) * per, total(of_word[:, 2]) * per, total(of_word[:, 4]) / letters, total(of_word[:, 5]) * per, total(of_word[:, 6]) * per, np.log1p(words), letters * per, np.log1p(total(near)),
    ], 1)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted
    points: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(x), *self.points), 0.0, 1.0)


def _training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, most: int) -> DataFrame:
    """At most about `most` labelled training texts, each text once: text, toxic, half."""
    marked = labels.where(F.col("toxic").isin(0, 1) & trains(F.col(doc_id))).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(1, marked.count()))
    picked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(trains(F.col("_id")))
    same = F.xxhash64("text")
    once = rows.join(picked, "_id").groupBy(same.alias("_h"), F.md5("text").alias("_m")).agg(F.max(F.struct("toxic", "text")).alias("r"))
    return once.select("r.text", "r.toxic", F.pmod(F.col("_h"), F.lit(2)).cast("int").alias("half"))


def _lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Entries and log odds from each half, and from both."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                coded = code_words(part.column("text"))
                of = [_entries(w) for w in coded.distinct]
                toxic, half = part.column("toxic").to_pylist(), part.column("half").to_pylist()
                counts: dict[tuple, list[int]] = {}
                for i in range(part.num_rows):
                    for e in {e for c in np.unique(coded.codes[coded.bounds[i] : coded.bounds[i + 1]]) for e in of[c]}:
                        counts.setdefault((e, half[i]), [0, 0])[toxic[i]] += 1
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], ["entry", "half", "clean", "toxic"])

    counted = rows.mapInArrow(entries, "entry string, half int, clean long, toxic long").groupBy("entry").pivot("half", [0, 1]).agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).na.fill(0)
    sizes = {h: [0, 0] for h in (0, 1)}
    for r in rows.groupBy("half", "toxic").count().collect():  # four rows
        sizes[r["half"]][r["toxic"]] = r["count"]
    counted = durable(counted)
    out = []
    for halves in ([0], [1], [0, 1]):
        toxic, clean = (sum((F.col(f"{h}_{k}") for h in halves), F.lit(0)) for k in "tc")
        n_clean, n_toxic = (sum(sizes[h][k] for h in halves) + 1 for k in (0, 1))
        odds = F.log((toxic + 0.5) / n_toxic) - F.log((clean + 0.5) / n_clean)
        top = counted.select("entry", odds.alias("odds"), toxic.alias("t")).where((F.col("t") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc(F.col("odds") * F.log1p("t")), "entry").limit(LEXICON)
        out.append({r["entry"]: r["odds"] for r in top.collect()})
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    rows = durable(_training_rows(docs, labels, doc_id, text, fit_rows))
    first, second, both = _lexicons(rows)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        known = [_WordFeatures(second), _WordFeatures(first)]
        for batch in batches:
            for part in slices(batch):
                half = np.asarray(part.column("half"))
                x = np.zeros((part.num_rows, FEATURES))
                for h in (0, 1):
                    if (half == h).any():
                        x[half == h] = features(part.column("text").filter(pa.array(half == h)), known[h])
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.array(x[:, j]) for j in range(FEATURES))], ["toxic", *(f"f{j}" for j in range(FEATURES))])

    names = [f"f{j}" for j in range(FEATURES)]
    got = rows.mapInArrow(table, f"toxic int, {', '.join(f'{n} double' for n in names)}").toPandas().sort_values([*names, "toxic"], ignore_index=True)
    x, y = got[names].to_numpy(), got["toxic"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(both, Boosted(), (np.array([0.0]), np.array([share])))
    raw, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        raw[fold == k] = fit_boosted(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(both, fit_boosted(x, y), fit_isotonic(raw, y))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordFeatures(model.lexicon)
        for batch in batches:
            for part in slices(batch):
                s = model.score(features(part.column("text"), known))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~trains(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, in one pass."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordFeatures(model.lexicon)
        for batch in batches:
            for part in slices(batch, names[at]):
                clean = model.score(features(part.column(at), known)) < threshold
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)

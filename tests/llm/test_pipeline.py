"""The whole pipeline against a plain Python version, stage by stage and at its end."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from runoff.llm import mixing, toxicity
from runoff.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, order_key string, _id int, score double"
BAD = ["vile", "rotten", "dreck"]


def rows_of():
    rng = random.Random(17)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(3, 7))) for _ in range(250)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    texts, toxic = [None, "", " \n", "one", "two words"], [0] * 5
    for _ in range(260):
        bad = rng.random() < 0.25
        text = prose(rng.randint(20, 120))
        for _ in range(8 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(BAD)
        texts.append(" ".join(text))
        toxic.append(int(bad))
    base, long = prose(140), " ".join(prose(9000))
    for k in range(9):
        near = list(base)
        near[11 * k] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [long, long, None, ""] + ["the very same text in many rows"] * 30
    toxic += [0] * (len(texts) - len(toxic))
    rows = [(None if i == 20 else i, t, None, None if i % 9 == 0 else ("big" if i % 3 else "small"), None, 7, "k", 1, 0.5) for i, t in enumerate(texts)]
    rows.append(rows[40])  # repeated in full
    return rows, [(i, t) for i, t in enumerate(toxic)]


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def first(i):
    """Identifiers in order, null after all others."""
    return (i is None, i or 0)


def expected_after(clean):
    """The documents that exact and near dedup leave, and those after mixing, as (doc_id, text, source)."""
    by_text = {}
    for r in clean:
        t = r[1] or ""
        if t not in by_text or (by_text[t][0] is None or r[0] is not None and r[0] > by_text[t][0]):
            by_text[t] = r
    unique = list(by_text.values())
    sets, label = [grams(r[1]) for r in unique], list(range(len(unique)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (a == b or len(a & b) / max(1, len(a | b)) >= 0.8)]
    for _ in unique:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    groups = defaultdict(list)
    for i, r in enumerate(unique):
        groups[label[i]].append(r)
    kept = [min(g, key=lambda r: first(r[0])) for g in groups.values()]
    size = Counter()
    for r in kept:
        size[r[3]] += len((r[1] or "").encode())
    weight = {s: b**mixing.TEMPERATURE for s, b in size.items()}
    mixed = []
    for r in kept:
        rate = weight[r[3]] / sum(weight.values()) * sum(size.values()) / size[r[3]] if size[r[3]] else 1.0
        u = (int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        mixed += [r] * n
    return kept, mixed


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels = rows_of()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    rows, labels = rows_of()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rejected = {r["text"] for r in docs.join(toxicity.score(docs, model).where("predicted = 1").select("doc_id").distinct(), "doc_id").collect()}
    truth = {rows[i][1] for i, t in labels if t}
    assert len(rejected & truth) > 0.8 * len(truth) and len(rejected - truth) < 10
    clean = [r for r in rows if r[1] not in rejected]

    stages, now = dict(corpus_pipeline.STAGES), docs
    for name in ("toxicity", "exact_dedup", "ngram_join", "mixing"):
        now = stages[name](spark, now, folder)
        assert now.columns == docs.columns
        got = Counter((r["doc_id"], r["text"]) for r in now.collect())
        kept, mixed = expected_after(clean)
        if name == "toxicity":
            assert got == Counter(r[:2] for r in clean)
        if name == "ngram_join":
            assert got == Counter(r[:2] for r in kept)
        if name == "mixing":
            assert got == Counter(r[:2] for r in mixed)

    out = corpus_pipeline.run(spark, folder).toPandas()
    tokenizer, pieces = Tokenizer.from_file(default_path()), Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            pieces[(r[0], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    whole = out[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(out[["doc_id", "piece", "start", "length", "ids_crc32"]].notna(), None)
    assert Counter((None if d is None else int(d), *map(int, rest)) for d, *rest in whole.itertuples(index=False)) == pieces
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part["length"].sum() <= 4096 and (part["offset"].to_numpy() == part["length"].cumsum().to_numpy() - part["length"].to_numpy()).all()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

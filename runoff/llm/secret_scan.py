"""Secret scan: fixed patterns, and sliding-window entropy of candidate strings.

Patterns give spans of the kinds assign, access and hex. Other candidates are runs of CANDIDATE characters. A window of
WINDOW characters slides along each; its Shannon entropy comes from counts of which each step changes two, by
H = log2(W) - sum(c * log2(c)) / W. A candidate that meets patterns' spans is cut to what lies outside them. It is of
the class of its characters (hexadecimal, lower-case letters, upper-case letters, letters, mixed), and is a span of the
kind entropy if some window reaches its class's threshold, unless an allow-list pattern matches all of it. Windows that
touch a placeholder don't count, those beside it do.

All of it is one pass without a shuffle; a text is split only by patterns that it holds. Places are code points.

Defined results: null text is empty; texts of any length are scanned whole. Equal rows give equal results. Empty tables give empty results. Extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns' texts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits that a window must reach, by class. Of random keys of 20, 24 and 32 characters, those of lower-case letters reach
#: theirs in 68, 83 and 95 %, of upper-case ones in 84, 94 and 99 %, of both cases in 96, 99 and 100 %; so do 6 of 38
#: words of 19 letters or more and 6 of 16 identifiers in camel case.
BITS = {"hex": 3.0, "lower": 3.6, "upper": 3.5, "letters": 3.7, "mixed": 3.7}
#: A word, or up to four words in camel case, and a short number.
_NAME = "(?:[A-Z]{1,15}|[A-Z]?[a-z]{0,14}(?:[A-Z][a-z]{1,14}){0,3})[0-9]{0,4}"
#: Candidates that are no secrets: identifiers in canonical form, separators, numbers and dates, paths and compound names.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[/_=+-]*$|^[0-9/_=+-]*$",
    f"^(?:{_NAME}[/_-])+{_NAME}$",
)
#: Alphabets and stand-ins within a candidate.
PLACEHOLDER = r"(?i)0123456789|abcdefghij|qwertyuiop|example|placeholder|x{6,}|your[_-]"
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _placed(text: Column, pattern: str) -> Column:
    """(start, end, text) of every match: what stands between matches tells where they are."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(F.transform(F.slice(between, 1, F.size(matches)), F.length), matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    return F.aggregate(sized, start, step, lambda acc: acc["out"])


def _spans(text: Column, kind: str, pattern: str, rule: Column | None = None) -> Column:
    """Spans of one kind, where the text holds the pattern at all."""
    found = rule if rule is not None else _placed(text, pattern)
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def most_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest entropy of a window of candidate, in bits; 0 where it is shorter."""
    weight = F.lit([0.0] + [c * math.log2(c) for c in range(1, window + 1)])
    codes = F.transform(F.split(candidate, ""), lambda ch: F.position(ch, F.lit(ALPHABET)))
    indexed = F.transform(codes, lambda c, i: F.struct(c.alias("come"), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0)).alias("go"), i.alias("i")))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        come, go = F.get(acc["n"], x["come"] - 1), F.get(acc["n"], F.greatest(x["go"] - 1, F.lit(0)))
        gain = F.get(weight, come + 1) - F.get(weight, come)
        loss = F.when(x["go"] > 0, F.get(weight, go - 1) - F.get(weight, go)).otherwise(F.lit(0.0))
        s = F.when(x["come"] == x["go"], acc["s"]).otherwise(acc["s"] + gain + loss)
        n = F.transform(acc["n"], lambda v, k: v + F.when(k + 1 == x["come"], 1).otherwise(0) - F.when(k + 1 == x["go"], 1).otherwise(0))
        best = F.when(x["i"] + 1 >= window, F.greatest(acc["best"], F.lit(math.log2(window)) - s / window)).otherwise(acc["best"])
        return F.struct(n.alias("n"), s.alias("s"), best.alias("best"))

    return F.aggregate(indexed, start, step, lambda acc: acc["best"])


def _outside(x: Column, spans: Column, least: int) -> Column:
    """The parts of a match (start, end, text) that lie in none of the sorted spans and have least characters or more."""
    met = F.filter(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    start = F.struct(x["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), b["start"].alias("end"))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    gaps = F.aggregate(met, start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x["end"].alias("end")))))
    text = lambda g: F.substring(x["m"], g["start"] - x["start"] + 1, g["end"] - g["start"])
    return F.transform(F.filter(gaps, lambda g: g["end"] - g["start"] >= least), lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), text(g).alias("m")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ALLOWED, placeholder: str = PLACEHOLDER) -> DataFrame:
    """doc_id, base and found: arrays of (start, rank of the kind, end), the patterns' spans and the entropy spans."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    values = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    long_enough = F.filter(F.zip_with(_placed(t, ASSIGN), values, lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), v.alias("v"))), lambda x: F.length(x["v"]) >= LEAST["assign"])
    # Runs of these classes are whole matches, so asking for the length in the pattern drops only the short ones.
    access, hexes = "AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4), "[0-9a-f]{%d,}" % LEAST["hex"]
    base = F.array_sort(F.concat(_spans(t, "assign", ASSIGN, long_enough), _spans(t, "access", access), _spans(t, "hex", hexes)))
    rows = rows.withColumn("base", base)

    def secret(x: Column) -> Column:
        m = x["m"]
        bits = F.when(m.rlike("^[0-9a-fA-F]+$"), BITS["hex"]).when(m.rlike("^[a-z]+$"), BITS["lower"]).when(m.rlike("^[A-Z]+$"), BITS["upper"]).when(m.rlike("^[A-Za-z]+$"), BITS["letters"]).otherwise(BITS["mixed"])
        free = F.lit(True)
        for pattern in allowed:
            free = free & ~m.rlike(pattern)
        most = F.array_max(F.transform(F.split(m, placeholder, -1), lambda part: most_entropy(part)))
        return free & F.when(free, most >= bits).otherwise(False)

    candidates = F.flatten(F.transform(_placed(t, CANDIDATE), lambda x: _outside(x, F.col("base"), WINDOW)))
    return rows.select("doc_id", "base", _spans(t, "entropy", CANDIDATE, F.filter(candidates, secret)).alias("found"))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    names = F.lit(list(KINDS))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "found"))).alias("spans"))

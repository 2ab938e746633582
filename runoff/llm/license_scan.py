"""Licence scan by a positional rare-token index.

The index holds postings (template, position) under the two words of each template's key phrase that have the highest
IDF over all documents. A file's words are looked up in it; a posting found at word i of the file and position p of the
phrase puts the phrase at i - p, and the postings of the first and of the second word are intersected by template and
that relative position. At each place that both agree on, the key phrase must stand word by word, and the template's
other words are compared at their own relative positions, which gives the share of the template that is present.

Templates are literals that a place names by number: neither the plan nor the work on a file grows with the templates
that it doesn't hold, but for the number of looked-up words. Everything about a file is decided in its own row, so the
scan neither shuffles nor explodes texts; files without a first word stop at one set test. Only the document frequency
of key words is gathered, a row for each such word.

Defined results: null text is empty and has no words; texts of any length are scanned whole. Overlapping places all
count. Equal rows give equal results, whatever their identifiers. Empty tables give empty results. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: digits, letters and everything beyond ASCII.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: What is lower-cased, and nothing beyond it.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A template and a place are one number: places in a file, from _BEFORE words before its start, times the template.
_PLACES, _BEFORE = 1 << 40, 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    text: str  #: words in order
    key: str  #: the phrase in text that must be present
    base: bool = False


# The phrases that always count.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
# Notices of public licences, some in full.
NOTICES = (
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template(
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without "
        "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    Template(
        "bsd-notice",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or "
        "implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
        "event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including "
        "but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory "
        "of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even "
        "if advised of the possibility of such damage",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "isc-notice",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this "
        "software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software",
        "permission to use copy modify",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software",
    ),
    Template(
        "zlib-notice",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the "
        "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you "
        "wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not "
        "required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not "
        "be removed or altered from any source distribution",
        "the origin of this software must not be misrepresented",
    ),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be "
        "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public "
        "license for more details",
        "gnu general public license as published by the free software foundation",
    ),
    Template(
        "apache-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
        "the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
        "you may not use this file except in compliance with the license",
    ),
)


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def inverse_frequencies(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[str, float]:
    """IDF of each word of the key phrases over all of docs."""
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    held = docs.select(F.array_intersect(_words(text), F.lit(vocabulary)).alias("held"))
    counted = held.select(F.explode(F.array_append("held", F.lit(""))).alias("word")).groupBy("word").count().collect()  # a row for each word, and all rows
    found = {r["word"]: r["count"] for r in counted}
    n = found.get("", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


@dataclass(frozen=True)
class Index:
    """Postings (template, position) of the words of the templates' key phrases that files are looked up by."""

    templates: tuple[Template, ...]
    postings: dict[str, list[tuple[int, int, bool]]]  #: word -> (template, position in its key, whether it is the second word)

    @classmethod
    def of(cls, templates: tuple[Template, ...], idf: dict[str, float]) -> Index:
        """A template stands under the two words of its key phrase with the highest IDF, or under its only one twice."""
        postings: dict[str, list[tuple[int, int, bool]]] = {}
        for t, template in enumerate(templates):
            key = template.key.split()
            rare = sorted(set(key), key=lambda w: (-idf[w], key.index(w)))
            for word, second in ((rare[0], False), (rare[min(1, len(rare) - 1)], True)):
                postings.setdefault(word, []).append((t, key.index(word), second))
        return cls(templates, postings)

    @property
    def first(self) -> list[str]:
        """The words without which no template is in a file."""
        return sorted(w for w, found in self.postings.items() if any(not second for *_, second in found))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, and found: an array of (start of the key phrase, label, base, share of the template)."""
    index = Index.of(templates, inverse_frequencies(docs, templates, text))
    keys, whole = [t.key.split() for t in templates], [t.text.split() for t in templates]
    leads = [next(i for i in range(len(w)) if w[i : i + len(k)] == k) for w, k in zip(whole, keys, strict=True)]
    posting = lambda p: F.struct(F.lit(p[0]).cast("long").alias("t"), F.lit(p[1]).cast("long").alias("p"), F.lit(p[2]).alias("second"))
    lookup = F.create_map(*[x for w, found in sorted(index.postings.items()) for x in (F.lit(w), F.array(*[posting(p) for p in found]))])
    words = F.col("_words")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _words(text).alias("_words"))

    # a hit's postings, each as one number: the template, and where its key phrase would start
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda h: F.array_contains(F.lit(sorted(index.postings)), h["w"]))
    posts = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(lookup, h["w"]), lambda p: F.struct((p["t"] * _PLACES + h["i"] - p["p"] + _BEFORE).alias("at"), p["second"].alias("second")))))
    rows = rows.withColumn("_posts", F.when(F.arrays_overlap(words, F.lit(index.first)), posts))
    of = lambda second: F.transform(F.filter("_posts", lambda p: p["second"] == F.lit(second)), lambda p: p["at"])
    rows = rows.withColumn("_both", F.array_intersect(of(False), of(True)))

    at = lambda table, c: F.element_at(table, (F.floor(c / _PLACES) + 1).cast("int"))
    start = lambda c: F.pmod(c, F.lit(_PLACES)) - _BEFORE
    nested, wholes = (F.array(*[F.lit(x) for x in t]) for t in (keys, whole))

    def stands(c: Column) -> Column:
        key = at(nested, c)
        return F.when(start(c) >= 0, F.slice(words, (start(c) + 1).cast("int"), F.size(key)) == key).otherwise(False)

    def place(c: Column) -> Column:
        text, lead = at(wholes, c), at(F.lit(leads), c)
        met = F.size(F.filter(text, lambda w, j: F.get(words, (start(c) - lead + j).cast("int")).eqNullSafe(w)))
        return F.struct(start(c).alias("start"), at(F.lit([t.label for t in templates]), c).alias("label"), at(F.lit([t.base for t in templates]), c).alias("base"), (met / F.size(text).cast("double")).alias("share"))

    empty = F.array().cast("array<struct<start:bigint,label:string,base:boolean,share:double>>")
    found = F.transform(F.filter("_both", stands), place)
    return rows.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.when(F.col("_both").isNotNull(), found).otherwise(empty).alias("found"))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("found", lambda f: f["base"])
    joined = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(a, lambda f: f["label"]))))
    starts = F.transform(base, lambda f: f["start"])
    best = F.array_max(F.transform("found", lambda f: f["share"]))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for summary(scan(documents)): every phrase tried at every word."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    parts = []
    for t in BASE + NOTICES:
        key, whole = t.key.split(), t.text.split()
        lead = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        met = f"len(list_filter(range(1, {len(whole) + 1}), lambda j: i - {lead + 1} + j >= 1 AND w[i - {lead + 1} + j] IS NOT DISTINCT FROM {quoted(whole)}[j]))"
        parts.append(f"SELECT doc_id, i - 1 AS start, '{t.label}' AS label, {str(t.base).lower()} AS base, {met} / {len(whole)}.0::DOUBLE AS share FROM spots WHERE w[i:i + {len(key) - 1}] = {quoted(key)}")
    return f"""
        WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        spots AS (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains({quoted(sorted({t.key.split()[0] for t in BASE + NOTICES}))}, w[i]))) AS i FROM words),
        found AS ({" UNION ALL ".join(parts)}),
        by_doc AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM words LEFT JOIN by_doc USING (doc_id)"""

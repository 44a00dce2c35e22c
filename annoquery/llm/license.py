"""License scan by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a window of words, or a line that is no longer than one: for templates of up to 16, 64 and 256 words (or the longest's number), windows
are three times as long and start at every half of their length, so each run of 1.5 times that length lies in one, whatever
lines it has, and words that are further apart than a window meet no template together. A block's set is its distinct words, ordered by frequency over all documents, rarest first, as a template's are. A block meets a
template if it holds at least ``threshold`` of the template's distinct words. Then it must share one of the template's first
``size - need + 1`` words (*prefix filter*), have at least ``need`` words (*length filter*), and after the first word they share, both
must have enough words left (*positional filter*). Pairs that pass are verified by whole intersections, so the result is exact.

One pass over all texts finds the base phrases and the listed words of each document; frequencies are counted from these. Only
documents that hold enough words of some template as a whole are read again and cut into blocks. The templates are a fixed small table.

Null texts count as empty. An empty table gives no rows. Repeated rows are scanned each.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

# Phrases whose consecutive words name a license, with its label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License templates, with their labels.
TEMPLATES = [
    ("this file is released under the terms of the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution share alike license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("all rights reserved no part may be reproduced without written permission", "proprietary"),
]

# Whole license texts, with their labels.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and
this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out
of or in connection with the software or the use or other dealings in the software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must
reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the
implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the
license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language
governing permissions and limitations under the license"""
GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but
without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
details"""
TEMPLATES += [(" ".join(text.split()), label) for text, label in ((MIT, "mit"), (BSD, "bsd"), (APACHE, "apache-2"), (GPL, "gpl-3"))]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(text: Column | str) -> Column:
    """Words of a text, A-Z in lower case, joined by one space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN, " "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(docs: DataFrame, listed: list[str]) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, the array ``base`` of labels, and which listed words a text has, by one narrow pass."""
    padded = docs.select("doc_id", "text_hash", F.concat(F.lit(" "), spaced_words("text"), F.lit(" ")).alias("p"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        mark = f" {phrase} "
        at = F.instr("p", mark)
        back = F.instr(F.reverse("p"), mark[::-1])
        counts.append(F.when(at > 0, F.regexp_count("p", F.lit(f"(?= {phrase} )"))).otherwise(0))
        firsts.append(F.when(at > 0, _spaces(F.substring("p", F.lit(1), at - 1))))
        lasts.append(F.when(at > 0, _spaces(F.substring("p", F.lit(1), F.length("p") - back + 2 - len(mark) - 1))))
        labels.append(F.when(at > 0, F.lit(label)))
    return padded.select(
        "doc_id",
        "text_hash",
        F.when(F.length("p") > 2, _spaces(F.col("p")) - 1).otherwise(0).cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        F.array_intersect(F.array(*map(F.lit, listed)), F.split("p", " ")).alias("listed"),
    )


def blocks_of(docs: DataFrame, reach: int) -> DataFrame:
    """doc_id, text_hash, block and its words, for templates of up to ``reach`` words: windows of three times as many words, which overlap by half, and lines that are no longer."""
    step = math.ceil(1.5 * reach)
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    lines = lines.select("doc_id", "text_hash", (-1 - F.col("at")).alias("block"), F.split(spaced_words("line"), " ").alias("words")).where(F.size("words") <= 2 * step)
    whole = docs.select("doc_id", "text_hash", F.split(spaced_words("text"), " ").alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - 2 * step) / step).cast("int")))
    return lines.unionAll(whole.select("doc_id", "text_hash", F.posexplode(F.transform(starts, lambda i: F.slice("words", i * step + 1, 2 * step))).alias("block", "words")))


def candidate_pairs(blocks: DataFrame, templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float) -> DataFrame:
    """Pairs of blocks and templates that pass the filters: with the block's listed words ``own`` and the template's ``words``, both in order, ``need`` and ``size``."""
    rows = []
    for i, (text, label) in enumerate(templates):
        words = sorted(set(text.split()), key=lambda w: (frequency[w], w))
        need = math.ceil(threshold * len(words) - 1e-9)
        rows += [(w, i, label, need, len(words), p, words) for p, w in enumerate(words[: len(words) - need + 1])]
    index = blocks.sparkSession.createDataFrame(rows, "word string, template int, label string, need int, size int, p int, words array<string>")
    order = F.array(*map(F.lit, sorted({w for t, _ in templates for w in t.split()}, key=lambda w: (frequency[w], w))))
    prefix = F.array(*map(F.lit, sorted({r[0] for r in rows})))
    own = blocks.select("doc_id", "text_hash", "block", F.array_intersect(order, "words").alias("own"))
    own = own.where((F.size("own") >= min(r[3] for r in rows)) & F.arrays_overlap("own", prefix))
    seeds = own.select("doc_id", "text_hash", "block", "own", F.posexplode("own").alias("q", "word"))
    pairs = seeds.join(F.broadcast(index), "word").where(F.size("own") >= F.col("need"))
    first = pairs.groupBy("doc_id", "text_hash", "block", "template").agg(F.min(F.struct("q", "p", "own", "label", "need", "size", "words")).alias("m"))
    left = F.least(F.size("m.own") - F.col("m.q"), F.col("m.size") - F.col("m.p"))  # words from the first shared one on
    return first.where(left >= F.col("m.need")).select("doc_id", "text_hash", "block", "template", "m.*")


def template_matches(docs: DataFrame, found: DataFrame, templates=None, threshold: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, text_hash, label, score: every (block, template) pair that meets the threshold. ``found`` has the listed words of each document."""
    templates = templates or TEMPLATES
    frequency = {w: 0 for t, _ in templates for w in t.split()}
    frequency |= {r["w"]: r["n"] for r in found.select(F.explode("listed").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row for each listed word
    enough = lambda t: F.size(F.array_intersect("listed", F.array(*map(F.lit, sorted(set(t.split())))))) >= math.ceil(threshold * len(set(t.split())) - 1e-9)
    some = enough(templates[0][0])
    for text, _ in templates[1:]:
        some = some | enough(text)
    ids = staged(found.where(some).select("doc_id", "text_hash").distinct(), "license-candidates")
    on = F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("d.text_hash") == F.col("i.text_hash"))
    read = docs.alias("d").join((F.broadcast(ids) if ids.count() <= broadcast_rows else ids).alias("i"), on, "left_semi")
    read, pairs = staged(read, "license-texts"), None
    for low, reach in pairwise((0, 16, 64, 256, max(257, *(len(t.split()) for t, _ in templates)))):
        own = [(t, label) for t, label in templates if low < len(t.split()) <= reach]
        if own:
            part = candidate_pairs(blocks_of(read, reach), own, frequency, threshold)
            pairs = part if pairs is None else pairs.unionByName(part)
    common = F.size(F.array_intersect("own", "words"))
    return pairs.where(common >= F.col("need")).select("doc_id", "text_hash", "label", (common / F.col("size")).alias("score"))


def scan_licenses(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document: base phrase places, base labels, all labels and the best score."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = staged(phrase_places(keyed, sorted({w for t, _ in TEMPLATES for w in t.split()})), "phrases")
    matched = template_matches(keyed, found, threshold=threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    joined = found.alias("d").join(
        matched.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash")), "left"
    )
    none = F.array().cast("array<string>")
    return joined.select(
        "d.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )

"""License scan: phrases, and an exact set-similarity join with notice templates.

A text block matches a template when it holds at least ``threshold`` of the
template's distinct words.  A block is a line, or, where no line of a paragraph
matches the template, the paragraph: neighbouring lines that have words, so that a
wrapped notice is found, with or without comment marks.  The join is exact:

* tokens are ordered by their frequency over all blocks, rarest first;
* a match of overlap ``a`` must share a token within the first ``|T| - a + 1``
  tokens of the template and ``|B| - a + 1`` of the block (prefix filter);
* blocks with fewer than ``a`` tokens cannot match (length filter);
* a shared token at places i and j leaves an overlap of at most
  ``min(i, j) + 1 + min(|B| - i, |T| - j) - 1`` (positional filter);
* what is left is verified on the whole sets.

What a line holds its paragraph holds too, so paragraphs are joined, and only the
lines of those that match are looked at.

Texts are read once: words that no template has cannot be shared, so what is written
of a text, and counted and joined from then on, is the phrase places and the template
words of its lines.

Defined results: a null or empty text has no words and no labels; null ids and
repeated rows each get their row; ties in frequency are ordered by word; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed values: (label, notice), the paragraphs of well known notices and licences.  A licence whose notice differs from
#: another's in a word or two (the other GNU and CC licences) is not told from it by containment, so it has none of its own.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
              "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
              "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
              "Software is furnished to do so, all subject to the following:"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
            "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
            "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
            "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE."),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                   "Public License as published by the Free Software Foundation"),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                   "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                   "associated documentation files"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                   "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
                   "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
                   "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
                   "Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software."),
)

#: Either case; the contract lowers A-Z and nothing else.
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MARK = "\u0001"
#: Bytes of template prefixes that are broadcast at most.
_BROADCAST = 8 << 20


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """Label and distinct words of each template."""
    out = []
    for label, notice in templates:
        clean = "".join(c if c.isalnum() else " " for c in notice.lower())
        out.append((label, sorted(set(clean.split()))))
    return out


def _array(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def phrase_places(docs: DataFrame, text: str = "text", phrases=PHRASES) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and the phrase labels ``_base``."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Words with one space before, between and after them: word k follows k + 1 spaces.
    spaced = docs.withColumn("_s", F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), _NOT_WORD, " "))
    s = F.col("_s")
    any_phrase = "(?i) (?:" + "|".join(phrases) + ") "
    place = "(?i)(?<= )(?=(?:" + "|".join(phrases) + ") )"
    marked = spaced.withColumn("_m", F.when(s.rlike(any_phrase), F.regexp_replace(s, place, _MARK)))
    m = F.col("_m")
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    label = [F.when(s.rlike(f"(?i) {p} "), F.lit(v)) for p, v in sorted(phrases.items(), key=lambda x: x[1])]
    n = (spaces(s) - 1).cast("long")
    return marked.withColumns({
        "n_words": n,
        "n_base": F.coalesce(F.length(m) - F.length(F.replace(m, F.lit(_MARK), F.lit(""))), F.lit(0)).cast("long"),
        "first_word": (spaces(F.substring_index(m, _MARK, 1)) - 1).cast("long"),
        "last_word": (n - spaces(F.substring_index(m, _MARK, -1))).cast("long"),
        "_base": F.when(m.isNotNull(), F.array_compact(F.array(*label))).otherwise(F.array().cast("array<string>")),
    }).drop("_s", "_m")


def _paragraphs(text: Column, block: str, vocabulary: list[str], least: int) -> Column:
    """The paragraphs (lines without words part them) that hold ``least`` of the vocabulary: the words of it in each line."""
    gap = f"(?:{block}){_NOT_WORD[:-1]}*(?:{block})"
    words = lambda x: F.split(F.regexp_replace(F.lower(x), _NOT_WORD, " "), " ", -1)
    known = _array(vocabulary)
    line = lambda x, i: F.struct(i.alias("line"), F.array_intersect(known, words(x)).alias("t"))
    paragraph = lambda x, i: F.struct(
        i.alias("part"), F.filter(F.transform(F.split(x, block, -1), line), lambda y: F.size(y["t"]) > 0).alias("lines"))
    found = F.transform(F.split(F.coalesce(text, F.lit("")), gap, -1), paragraph)
    together = lambda p: F.array_distinct(F.flatten(F.transform(p["lines"], lambda y: y["t"])))
    return F.filter(found, lambda p: F.size(together(p)) >= least)


def template_matches(docs: DataFrame, *, text: str = "text", threshold: float = 0.8, block: str = "\n",
                     templates=TEMPLATES) -> DataFrame:
    """(_id, _hash, _block, label, containment) of every block that meets the threshold.

    ``docs`` has ``_id`` and ``_hash``, which identify the text of a row.
    """
    vocabulary, least = _vocabulary(templates, threshold)
    read = materialize(docs.select("_id", "_hash", _paragraphs(F.col(text), block, vocabulary, least).alias("_parts")), "license-words")
    return _matches(read, threshold, templates)


def _vocabulary(templates, threshold: float) -> tuple[list[str], int]:
    sets = [words for _, words in template_words(templates)]
    return sorted({w for words in sets for w in words}), min((math.ceil(threshold * len(words) - 1e-9) for words in sets), default=1)


def _matches(read: DataFrame, threshold: float, templates) -> DataFrame:
    """``template_matches`` of a written table with the paragraphs of each text."""
    spark, sets = read.sparkSession, template_words(templates)
    need = [math.ceil(threshold * len(words) - 1e-9) for _, words in sets]
    vocabulary, least = _vocabulary(templates, threshold)
    blocks = read.select("_id", "_hash", F.explode("_parts").alias("p")).select("_id", "_hash", F.col("p.part").alias("_part"), F.col("p.lines").alias("_lines"))
    # Frequencies over all blocks: as many rows as the templates have words.
    counted = blocks.select(F.explode(F.flatten(F.transform("_lines", lambda y: y["t"]))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    held = blocks.withColumn("_t", F.array_intersect(_array(order), F.flatten(F.transform("_lines", lambda y: y["t"]))))
    probes = held.select("*", F.posexplode(F.slice("_t", F.lit(1), F.size("_t") - least + 1)).alias("_i", "_w"))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for k, ((label, own), a) in enumerate(zip(sets, need)):
        ordered = sorted(own, key=rank.get)
        rows += [(k, label, ordered, a, j, w) for j, w in enumerate(ordered[: len(ordered) - a + 1])]
    prefixes = spark.createDataFrame(rows, "_template int, label string, _own array<string>, _need int, _j int, _w string")
    # Templates are a parameter: what they come to is counted before it is sent to all tasks.
    if sum(len(w) + 8 for r in rows for w in r[2]) <= _BROADCAST:
        prefixes = F.broadcast(prefixes)
    own = F.size("_own")
    size = F.size("_t")
    ahead = F.least(F.col("_i"), F.col("_j")) + F.least(size - F.col("_i"), own - F.col("_j"))
    candidates = (probes.join(prefixes, "_w")
                  .where((size >= F.col("_need")) & (F.col("_i") <= size - F.col("_need")) & (ahead >= F.col("_need"))))
    shared = F.size(F.array_intersect("_own", "_t"))
    found = candidates.withColumn("_shared", shared).where(F.col("_shared") >= F.col("_need"))
    by_line = F.transform("_lines", lambda y: F.struct(y["line"].alias("line"), F.size(F.array_intersect("_own", y["t"])).alias("shared")))
    lines = F.filter(by_line, lambda x: x["shared"] >= F.col("_need"))
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.col("_shared").alias("shared")))
    each = (found.withColumn("_l", lines).withColumn("_l", F.explode(F.when(F.size("_l") > 0, F.col("_l")).otherwise(whole)))
            .withColumns({"_block": F.struct("_part", "_l.line"), "_shared": F.col("_l.shared")}))
    return (each.groupBy("_id", "_hash", "_block", "_template").agg(F.first("label").alias("label"),
                                                               F.max(F.col("_shared") / own).alias("containment")))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, block: str = "\n",
         phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document: the phrase places, all labels and a score.

    ``score`` is 1 where a phrase stands, else the best containment of a
    matching template, else 0.
    """
    vocabulary, least = _vocabulary(templates, threshold)
    own = docs.select(F.col(key), F.col(text), F.coalesce(F.col(key).cast("string"), F.lit("\u0000")).alias("_id"),
                      F.xxhash64(text).alias("_hash"), _paragraphs(F.col(text), block, vocabulary, least).alias("_parts"))
    read = materialize(phrase_places(own, text, phrases).drop(text), "license-words")
    per_text = materialize(_matches(read, threshold, templates).groupBy("_id", "_hash").agg(
        F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"), F.countDistinct("_block").alias("n_blocks")), "licenses")
    joined = read.drop("_parts").join(per_text, ["_id", "_hash"], "left")
    nothing = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_labels", nothing)))
    return joined.select(
        key, "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )

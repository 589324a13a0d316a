r"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

Words are runs of letters and digits (all that is not ASCII punctuation or
white space) of the text with A-Z lower-cased; lines and comment marks don't
matter. Templates are whole notices and the one-line references to licenses. A
template of l words has as its blocks all runs of ceil(SLACK * l) consecutive
words of a text (shorter at its end) that begin with one of its words. It
belongs to a block that holds at least `threshold` of its n distinct words.

The join: the words of all templates are ordered by the number of texts that
hold them, rarest first, counted over the whole corpus. A template needs
c = ceil(threshold * n) of its words, so a text or block that matches holds one
of its first n - c + 1 (prefix filter), has c template words or more (length
filter), and at the first common word enough are left on both sides
(positional filter). What passes is verified by the complete overlap.

The templates are a parameter, so their index is a literal array in the plan
and the join needs no shuffle. Counting gathers one row for each template
word. DataFrame functions only.

Null text: no words, no places, no blocks, score 0; empty text alike. Very long
texts are scanned whole. Null ids and repeated rows: rows are independent.
Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import LOWER, UPPER
from corpusloom.llm._common import running as _running

THRESHOLD, SLACK = 0.9, 1.25
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ODD = "İK"  # the letters beyond ASCII whose lower case has an ASCII letter
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_AS_IS = (
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: Common notices and references to them, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, " + _AS_IS),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
)


def _sequence(text: str) -> list[str]:
    return re.sub(_GAP, " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split()


def _words(text: str) -> list[str]:
    return sorted(set(_sequence(text)))


def block_length(text: str) -> int:
    """The words of a template's block."""
    return math.ceil(SLACK * len(_sequence(text)) - 1e-9)


def normal(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, one space between.

    Words are only compared with ASCII ones, so other letters may be lower-cased too, but those of _ODD.
    """
    text = F.coalesce(text, F.lit(""))
    odd = text.contains(_ODD[0]) | text.contains(_ODD[1])
    return F.trim(F.regexp_replace(F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text)), _GAP, " "))


def _literal(rows: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _places(label: str, k: int) -> Callable[[Column], Column]:
    """From the pieces around the places of a phrase of k words to array<struct<word, label>>."""

    def at(pieces: Column) -> Column:
        passed = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))))
        return F.transform(_running(passed), lambda n, i: F.struct((n + F.get(passed, i) + i * k).alias("word"), F.lit(label).alias("label")))

    return at


def phrases(norm: Column, phrases: dict = PHRASES) -> Column:
    """array<struct<word, label>> of every place of a phrase in the words `norm`, in the order of words."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    parts = []
    for phrase, label in phrases.items():
        # pieces before each place: their spaces are the words passed; the space behind a place is left to the next
        pieces = F.split(padded, f" {phrase}(?= )", -1)
        parts.append(F.when(padded.contains(f" {phrase} "), _let(pieces, _places(label, phrase.count(" ") + 1))))
    none = F.array().cast("array<struct<word:bigint,label:string>>")
    return F.array_sort(F.concat(*(F.coalesce(p, none) for p in parts)))


def word_order(docs: DataFrame, text_col: str = "text", templates: tuple = TEMPLATES) -> list[str]:
    """The templates' words, by the number of texts that hold them."""
    vocabulary = sorted({w for _, t in templates for w in _words(t)})
    held = docs.select(F.split(normal(F.col(text_col)), " ").alias("w")).select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), "w")).alias("w"))
    counted = dict(held.groupBy("w").agg(F.count(F.lit(1))).collect())  # a row for each template word at most
    return sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))


def blocks(words: Column, order: list[str], templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<template, label, word, containment>>: every block of a text, by its first word, and template that it contains to the threshold."""
    rank = {w: i for i, w in enumerate(order)}
    facts = []
    for i, (label, text) in enumerate(templates):
        own = sorted(rank[w] for w in _words(text))
        need = math.ceil(threshold * len(own) - 1e-9)
        facts.append({"template": i, "label": label, "words": own, "prefix": own[: len(own) - need + 1], "need": need, "length": block_length(text)})
    index = _literal(facts, "array<struct<template:int,label:string,words:array<int>,prefix:array<int>,need:int,length:int>>")
    rare = F.array(*(F.lit(order[r]) for r in sorted({r for f in facts for r in f["prefix"]})))
    ranks = F.create_map(*(x for w, r in rank.items() for x in (F.lit(w), F.lit(r))))
    none = F.array().cast("array<struct<template:int,label:string,word:int,containment:double>>")

    def shared(block: Column, t: Column) -> Column:
        """Common words of a block, its template words in order, and t; null if a filter rejects the pair."""
        first = F.get(F.array_intersect(block, t["prefix"]), F.lit(0))
        left = lambda ws: F.size(ws) - F.array_position(ws, first).cast("int") + 1
        return F.when((F.size(block) >= t["need"]) & first.isNotNull() & (left(block) >= t["need"]) & (left(t["words"]) >= t["need"]), F.size(F.array_intersect(block, t["words"])))

    def of(held: Column, t: Column) -> Column:
        def at(h: Column) -> Column:
            near = F.filter(F.slice(held, h["k"] + 1, t["length"]), lambda x: x["p"] < h["p"] + t["length"])
            block = F.array_sort(F.array_distinct(F.transform(near, lambda x: x["r"])))
            return F.struct(t["template"].alias("template"), t["label"].alias("label"), h["p"].alias("word"), (_let(block, lambda b: shared(b, t)) / F.size(t["words"])).alias("containment"))

        found = F.transform(F.filter(held, lambda h: F.array_contains(t["words"], h["r"])), at)
        return F.filter(found, lambda b: b["containment"] >= t["need"] / F.size(t["words"]))

    def search(words: Column) -> Column:
        numbered = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x["w"].isin(order))
        held = F.transform(numbered, lambda x, k: F.struct(x["p"].alias("p"), ranks[x["w"]].alias("r"), k.alias("k")))
        return _let(held, lambda held: _let(F.array_sort(F.array_distinct(F.transform(held, lambda h: h["r"]))), lambda all_: F.flatten(F.transform(
            F.filter(index, lambda t: shared(all_, t) >= t["need"]), lambda t: of(held, t)))))

    return F.when(F.arrays_overlap(words, rare), _let(words, search)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, places, blocks, found array<struct<label, containment>>, score) for every row; found: of each label its best block."""
    order = word_order(docs, text_col, templates)
    d = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("norm"))
    n = F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1).cast("long")
    d = d.select("id", n.alias("n_words"), phrases(F.col("norm")).alias("places"), F.split("norm", " ").alias("words"))
    d = d.select("id", "n_words", "places", blocks(F.col("words"), order, templates, threshold).alias("blocks"))
    best = lambda label: F.array_max(F.transform(F.filter("blocks", lambda b: b["label"] == label), lambda b: b["containment"]))
    found = F.transform(F.array_sort(F.array_distinct(F.transform("blocks", lambda b: b["label"]))), lambda label: F.struct(label.alias("label"), best(label).alias("containment")))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
    return d.select(F.col("id").alias(id_col), "n_words", "places", "blocks", found.alias("found"), score.alias("score"))

"""License scan by a positional rare-token index, in built-in functions only.

Templates are notices, from one line to a whole licence text; each has mandatory key phrases
at known positions. A phrase has an anchor, its word of the highest IDF over the corpus, and a
template is filed under the rarest of its anchors. A file ranks its own licence words by IDF
and looks them up, rarest first; a template fetched that way whose other anchors the file has
too is a candidate. Only the candidates' anchors are located: a posting says where the anchor
stands in the phrase and where the phrase stands in the template, so every hit fixes the
relative position of both:

* the phrase is verified word by word at its place (consecutive words);
* the hits are sorted by template and relative position; a template counts where all its key
  phrases stand at the same one;
* its coverage is the share of the template's words found at their relative positions.

Everything about a file happens in its own row: no row is shuffled, exploded or collected.
The index is a literal of the plan, bounded by ``MAX_PHRASES``; only the document
frequencies of its words (one row each) come to the driver.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PHRASES = 500

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    notice: str
    keys: tuple[str, ...]
    base: bool = False


# The base phrases and their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices as commonly written, with the phrases that must be there.
TEMPLATES = (
    Template("cc-by", "licensed under cc by", ("cc by",), True),
    Template("gpl", "licensed under the gnu general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted", "free of charge")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc0", "dedicated to the public domain under cc0", ("public domain", "cc0")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify", "for any purpose")),
    Template("unlicense", "free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    # Whole texts and file headers, as their publishers give them.
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge", "publish distribute sublicense", "substantial portions of the software", "fitness for a particular purpose and noninfringement")),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce")),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ("apache license version 2 0", "except in compliance with the license", "without warranties or conditions of any kind", "governing permissions and limitations")),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("redistribute it and or modify it", "gnu general public license as published", "free software foundation", "in the hope that it will be useful")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ("permission to use copy modify and or distribute", "with or without fee", "appear in all copies")),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("source code form is subject to the terms", "mozilla public license", "if a copy of the mpl")),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software", "released into the public domain", "commercial or non commercial and by any means")),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


class Phrase(NamedTuple):
    template: int
    at: int  # of the phrase in the template
    words: tuple[str, ...]
    base: bool


def phrases(templates: tuple[Template, ...]) -> list[Phrase]:
    out = []
    for t, tpl in enumerate(templates):
        notice = words_of(tpl.notice)
        for key in tpl.keys:
            k = words_of(key)
            at = next(i for i in range(len(notice)) if notice[i : i + len(k)] == k)
            out.append(Phrase(t, at, tuple(k), tpl.base))
    if len(out) > MAX_PHRASES:
        raise ValueError(f"{len(out)} key phrases; the index is a plan literal of at most {MAX_PHRASES}")
    return out


def lower_words(text: Column) -> Column:
    """Words after lower-casing A-Z. ``lower`` also maps other letters, which no license
    word contains; only the Kelvin sign would become an ASCII letter, so it is replaced by
    another non-ASCII letter first. Word borders and positions stay."""
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), SEPARATORS)


def idf(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, float]:
    """IDF of the index's words over all documents: one row per word reaches the driver."""
    words = F.array_intersect(lower_words(F.col(text_col)), F.expr(_list(vocabulary, "string")))
    present = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = docs.count()
    seen = {r.word: r.df for r in present.collect()}  # at most len(vocabulary) rows
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}


def _list(values, kind: str) -> str:
    """SQL text of a literal array of words (without quotes or spaces) or numbers. The index is
    written as SQL text because one Column object per entry makes a plan slow to build."""
    return f"cast(split('{' '.join(map(str, values))}', ' ') AS array<{kind}>)" if len(values) else f"cast(array() AS array<{kind}>)"


def _lists(rows, kind: str) -> Column:
    return F.expr(f"array({', '.join(_list(r, kind) for r in rows)})")


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with the column ``license``: struct of n_words, n_base, first_word, last_word,
    base_labels, labels, score and places (label, start word, coverage).

    Words are lower-cased (A-Z) runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``; n_words counts
    them. n_base counts
    every place of a base phrase, first_word and last_word are the smallest and largest start
    (null without one). labels has the base labels and the labels of templates whose key
    phrases all stand at one relative position; both are distinct, sorted and comma-joined.
    score is the largest coverage of a template found (0 without one). Null text is empty and
    gives no place; repeated rows are scanned each on their own; other columns are carried as
    they are (a column named license is replaced)."""
    index = phrases(templates)
    vocabulary = sorted({w for p in index for w in p.words})
    rarity = idf(docs, vocabulary, text_col)
    rank = lambda w: (rarity[w], w)
    anchor = [max(((*rank(w), -i) for i, w in enumerate(p.words)))[1:] for p in index]  # word, -place in the phrase
    anchors = sorted({w for w, _ in anchor}, key=rank, reverse=True)  # rarest first
    slot = {w: k + 1 for k, w in enumerate(anchors)}
    slots = [sorted({slot[anchor[n][0]] for n, p in enumerate(index) if p.template == t}) for t in range(len(templates))]
    notices = _lists([words_of(t.notice) for t in templates], "string")
    labels = F.expr(_list([t.label for t in templates], "string"))
    needed = F.expr(_list([len(t.keys) for t in templates], "int"))
    posting = lambda n: (
        f"named_struct('template', {index[n].template}, 'anchor_at', {-anchor[n][1]}, 'at', {index[n].at}, "
        f"'words', {_list(index[n].words, 'string')}, 'base', {str(index[n].base).lower()})")
    of_anchor = [[posting(n) for n in range(len(index)) if anchor[n][0] == w] for w in anchors]
    postings = F.expr(f"array({', '.join('array(' + ', '.join(ps) + ')' for ps in of_anchor)})")
    filed = _lists([[t for t, s in enumerate(slots) if s[0] == k + 1] for k in range(len(anchors))], "int")
    others = _lists(slots, "int")
    ranked = F.expr(_list(anchors, "string"))
    tmp = "_lic_words"
    split = lower_words(F.col(text_col))
    d = docs.withColumn(tmp, split)
    # a text that starts with a separator has an empty first part
    d = d.withColumn(tmp, F.when(F.element_at(tmp, 1) == "", F.slice(tmp, 2, F.greatest(F.size(tmp) - 1, F.lit(0)))).otherwise(F.col(tmp)))
    # the file's own licence words, rarest first, as places in the ranking
    d = d.withColumn("_lic_own", F.transform(F.array_intersect(ranked, F.col(tmp)), lambda w: F.array_position(ranked, w).cast("int")))
    # templates filed under one of them, all of whose anchors the file has
    candidates = F.filter(F.flatten(F.transform("_lic_own", lambda k: F.element_at(filed, k))),
                          lambda t: F.size(F.array_except(F.element_at(others, t + 1), F.col("_lic_own"))) == 0)
    d = d.withColumn("_lic_active", F.array_distinct(F.flatten(F.transform(candidates, lambda t: F.element_at(others, t + 1)))))
    # look-up: (position, place in the ranking) of the candidates' anchors
    found = F.filter(
        F.transform(tmp, lambda w, i: F.struct(i.alias("i"), F.array_position(ranked, w).cast("int").alias("slot"))),
        lambda x: F.array_contains("_lic_active", x["slot"]))
    none = F.array().cast("array<struct<i:int,slot:int>>")
    d = d.withColumn("_lic_found", F.when(F.size("_lic_active") == 0, none).otherwise(found))
    hits = F.flatten(F.transform("_lic_found", lambda x: F.transform(
        F.element_at(postings, x["slot"]),
        lambda p: F.struct((x["i"] - p["anchor_at"]).alias("start"), p.alias("p")))))
    verified = F.filter(hits, lambda h: (h["start"] >= 0) & (F.slice(F.col(tmp), F.greatest(h["start"], F.lit(0)) + 1, F.size(h["p"]["words"])) == h["p"]["words"]))
    d = d.withColumn("_lic_hits", F.transform(verified, lambda h: F.struct(
        h["start"].alias("start"), h["p"]["template"].alias("template"),
        (h["start"] - h["p"]["at"]).alias("offset"), h["p"]["base"].alias("base"))))
    # a template stands where all its key phrases agree on its offset: sorted, its run of equal
    # hits is as long as it has phrases
    d = d.withColumn("_lic_sorted", F.array_sort(F.transform("_lic_hits", lambda h: F.struct(h["template"].alias("template"), h["offset"].alias("offset")))))
    runs = F.col("_lic_sorted")
    agreed = F.filter(runs, lambda x, i: ((i == 0) | (F.get(runs, i - 1) != x)) & (F.get(runs, i + F.element_at(needed, x["template"] + 1) - 1) == x))

    def coverage(t):
        notice = F.element_at(notices, t["template"] + 1)
        same = F.filter(F.sequence(F.lit(0), F.size(notice) - 1), lambda j: F.get(F.col(tmp), t["offset"] + j) == F.element_at(notice, j + 1))
        return F.size(same) / F.size(notice)

    d = d.withColumn("_lic_places", F.transform(agreed, lambda t: F.struct(
        F.element_at(labels, t["template"] + 1).alias("label"), t["offset"].alias("start"), coverage(t).alias("coverage"))))
    base = F.filter("_lic_hits", lambda h: h["base"])
    # a text that ends with a separator has an empty last part
    n_words = F.size(tmp) - F.when(F.get(F.col(tmp), F.size(tmp) - 1) == "", F.lit(1)).otherwise(F.lit(0))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base_labels = F.transform(base, lambda h: F.element_at(labels, h["template"] + 1))
    out = F.struct(
        n_words.cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("_lic_places", lambda p: p["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("_lic_places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
        F.col("_lic_places").alias("places"))
    return d.withColumn("license", out).drop(tmp, "_lic_own", "_lic_active", "_lic_found", "_lic_hits", "_lic_sorted", "_lic_places")

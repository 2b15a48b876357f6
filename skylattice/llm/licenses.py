"""Operator 9: licence scans with DataFrame functions only.

Text is normalised (lower case, everything but letters and digits is a blank) and cut into passages: lines, paragraphs,
the whole text, and stretches of a template's length round each word that a match must hold, laid as that word lies in the
template; so a notice is found within longer lines and paragraphs as well. A passage is held against a licence template by the Dice coefficient of their sets of word bigrams,
and only against templates whose size lets the coefficient reach the threshold: ``2 * min(n, m) / (n + m)`` bounds it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geometry import hold, let

#: Licence templates by SPDX-like name. Fixed values.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
THRESHOLD = 0.8
#: Words too frequent to tell a licence from other prose. Fixed values.
COMMON = frozenset("a above all an and any as at be by for from hereby in is may not of on or out person that the this to under use with without you".split())
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def bigrams(words: Column) -> Column:
    """The set of word bigrams of an array of words; of one word, that word."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) < 2, words).otherwise(F.array_distinct(pairs))


def plain_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")


def passages(plain: Column) -> Column:
    """Distinct normalised passages of a text made plain: its lines, its paragraphs and the whole."""
    blocks = F.split(plain, r"\n *\n")
    return F.array_distinct(F.transform(F.concat(F.split(plain, "\n"), blocks, F.array(plain)), lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))))


def words_in(text: str) -> list[str]:
    """Words of a template, by the same normalisation."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def laid(templates: dict[str, str], threshold: float) -> dict[str, list[tuple[int, int]]]:
    """For each word that a match must hold: how far a template begins before it, and the template's length in words. Places
    of one word in one template count up to the third."""
    out: dict[str, set[tuple[int, int]]] = {}
    for name, text in templates.items():
        words = words_in(text)
        for word in anchors(sizes({name: text}), threshold):
            for at in [i for i, w in enumerate(words) if w == word][:3]:
                out.setdefault(word, set()).add((at, len(words)))
    return {word: sorted(places) for word, places in sorted(out.items())}


def stretches(words: Column, places: dict[str, list[tuple[int, int]]], radix: int) -> Column:
    """Where templates would lie in an array of words by each word of ``places``: distinct numbers ``start * radix + length``."""
    lies = F.create_map(*(x for word, some in places.items() for x in (F.lit(word), F.array(*(F.struct(F.lit(a).alias("back"), F.lit(n).alias("length")) for a, n in some)))))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(*places))
    number = lambda x, t: F.greatest(x["at"] - t["back"], F.lit(0)).cast("long") * radix + t["length"]
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(lies, x["word"]), lambda t: number(x, t)))))


def sizes(templates: dict[str, str]) -> dict[str, list[str]]:
    """Each template's bigrams, by the same normalisation."""
    out = {}
    for name, text in templates.items():
        words = words_in(text)
        out[name] = list(dict.fromkeys(" ".join(x) for x in zip(words, words[1:], strict=False))) or words
    return out


def anchors(known: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which a passage must hold at least one to reach ``threshold`` with any template.

    A coefficient of t takes at least ``t * m / (2 - t)`` of a template's m bigrams. So words (the longest first) that
    touch more bigrams than may be missing cannot all be absent. Common words are taken last.
    """
    found: set[str] = set()
    for grams in known.values():
        spare = len(grams) - math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
        touched: set[str] = set()
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON or w.isdigit(), -len(w), w)):
            if len(touched) > spare:
                break
            found.add(word)
            touched |= {g for g in grams if word in g.split()}
    return sorted(found)


def scan(df: DataFrame, *, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, license, score, n_matches``, one row for each row of ``df``.

    ``license`` is the template with the best Dice coefficient of ``threshold`` or more over all passages (ties: the first
    name in alphabetical order) and ``score`` that coefficient; both are null if there is none. ``n_matches`` counts the
    pairs of distinct passage and template that reach the threshold. A null or empty text matches nothing. Null ids and
    repeated rows pass through. Whole texts are read; other columns are not. The work grows with a text's length, however many
    anchors it holds: of its stretches those that are equal are looked at once, and those most of whose bigrams no template
    has not at all.
    """
    known = sizes(templates or TEMPLATES)
    places = laid(templates or TEMPLATES, threshold)
    radix = 1 + max(n for some in places.values() for _, n in some)
    bounds = {name: (len(x) * threshold / (2 - threshold), len(x) * (2 - threshold) / threshold) for name, x in known.items()}
    low, high = min(a for a, _ in bounds.values()), max(b for _, b in bounds.values())
    stencils = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, x)).alias("grams"), F.lit(bounds[name][0]).alias("low"), F.lit(bounds[name][1]).alias("high")) for name, x in sorted(known.items())))
    every = sorted({g for grams in known.values() for g in grams})
    anchor = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(anchors(known, threshold))})(?![\p{{L}}\p{{N}}])"
    holds = lambda x: F.rlike(x, F.lit(anchor))

    def compare(grams: Column) -> Column:
        fits = F.filter(stencils, lambda t: (F.size(grams) >= t.low) & (F.size(grams) <= t.high))
        return F.transform(fits, lambda t: F.struct((-2.0 * F.size(F.array_intersect(grams, t.grams)) / (F.size(grams) + F.size(t.grams))).alias("score"), t["name"].alias("name")))

    def cut(x: Column, of: str, less: int = 0) -> Column:
        return F.slice(of, (F.floor(x / radix) + 1).cast("int"), (x % radix - less).cast("int"))

    # Each step is worked out once a row. All but the few texts that hold an anchor go through the steps as null.
    some = df.select(F.col(id_col).alias("doc"), F.when(holds(F.lower(F.coalesce(F.col(text_col), F.lit("")))), plain_text(F.col(text_col))).alias("plain"))
    some = hold(some, words=F.split(F.trim(F.translate("plain", "\n", " ")), " +"), whole=F.filter(passages(F.col("plain")), holds)).drop("plain")
    # A bigram is a number of its own, above 0 if any template has it.
    gram = F.transform(F.slice("words", 1, F.size("words") - 1), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    code = F.transform(gram, lambda g: F.when(g.isin(*every), F.abs(F.xxhash64(g))).otherwise(-F.abs(F.xxhash64(g))))
    some = hold(some, codes=F.when(F.size("words") > 1, code).otherwise(F.when(F.col("words").isNotNull(), F.array().cast("array<bigint>"))), laid=stretches(F.col("words"), places, radix))
    # Equal stretches of a text become neighbours by their hashes, and one of them is looked at.
    some = hold(some, sorted=F.sort_array(F.transform("laid", lambda x: F.struct(F.xxhash64(cut(x, "words")).alias("hash"), x.alias("at"))))).drop("laid")
    as_before = lambda x, y: (x["hash"] == y["hash"]) & (cut(x["at"], "words") == cut(y["at"], "words"))
    new = F.filter("sorted", lambda x, i: (i == 0) | ~F.coalesce(as_before(x, F.get("sorted", i - 1)), F.lit(False)))
    some = hold(some, new=F.transform(new, lambda x: x["at"])).drop("sorted")

    def may_reach(x: Column) -> Column:
        # A coefficient of t takes t / (2 - t) of a passage's own bigrams.
        own = F.array_distinct(cut(x, "codes", 1))
        return let(lambda v: F.size(F.filter(v["own"], lambda c: c > 0)) >= F.size(v["own"]) * (threshold / (2 - threshold)) - 1e-9, own=own)

    some = hold(some, near=F.transform(F.filter("new", may_reach), lambda x: F.concat_ws(" ", cut(x, "words")))).drop("new", "codes", "words")
    # A set of n bigrams takes n + 1 words at least; repeats can make a passage longer, so only the lower bound is on words.
    words = F.filter(F.transform(F.array_distinct(F.concat("whole", "near")), lambda x: F.split(x, " +")), lambda w: F.size(w) > low)
    grams = F.filter(F.transform(words, bigrams), lambda g: (F.size(g) >= low) & (F.size(g) <= high))
    found = hold(some, reached=F.filter(F.flatten(F.transform(grams, compare)), lambda x: x.score <= -threshold))
    best = F.array_min("reached")
    return found.select(F.col("doc").alias(id_col), best["name"].alias("license"), F.round(-best["score"], 6).alias("score"), F.coalesce(F.size("reached"), F.lit(0)).cast("long").alias("n_matches"))


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan`` over ``documents`` (whose ids differ), by way of rows instead of arrays and without anchors."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in (templates or TEMPLATES).items())
    plain = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    t = f"{threshold!r}::double"
    places = ", ".join(f"('{word}', {a}, {n})" for word, some in laid(templates or TEMPLATES, threshold).items() for a, n in some)
    return f"""
with template(name, text) as (values {values}),
t_word as (select name, string_split(trim(replace({plain.format('text')}, chr(10), ' ')), ' ') as w from template),
t_gram as (select distinct name, w[i] || ' ' || w[i + 1] as gram from t_word, unnest(range(1, len(w))) as r(i)),
t_size as (select name, count(*) as m from t_gram group by name),
body as (select doc_id, {plain.format('text')} as p from documents),
lie(word, back, n) as (values {places}),
worded as (select doc_id, regexp_split_to_array(trim(replace(p, chr(10), ' ')), ' +') as w from body),
hit_word as (select doc_id, w, i - 1 as i, w[i] as word from worded, unnest(range(1, len(w) + 1)) as r(i)),
stretch as (select doc_id, array_to_string(w[greatest(i - back, 0) + 1 : greatest(i - back, 0) + n], ' ') as p from hit_word join lie using (word)),
passage as (
  select doc_id, regexp_replace(trim(replace(x, chr(10), ' ')), ' +', ' ', 'g') as p
  from (select doc_id, unnest(list_concat(string_split(p, chr(10)), list_concat(regexp_split_to_array(p, '\\n *\\n'), [p]))) as x from body)
  union select doc_id, p from stretch),
gram as (
  select distinct doc_id, p, w[i] || ' ' || w[i + 1] as gram
  from (select doc_id, p, regexp_split_to_array(p, ' +') as w from passage), unnest(range(1, len(w))) as r(i)),
size as (select doc_id, p, count(*) as n from gram group by doc_id, p),
pair as (select doc_id, p, n, name, m from size, t_size where n >= m * {t} / (2 - {t}) and n <= m * (2 - {t}) / {t}),
dice as (
  select pair.doc_id, pair.p, pair.name, 2.0::double * count(t_gram.gram) / (n + m) as score
  from pair left join gram on gram.doc_id = pair.doc_id and gram.p = pair.p left join t_gram on t_gram.name = pair.name and t_gram.gram = gram.gram
  group by pair.doc_id, pair.p, pair.name, n, m),
hit as (select doc_id, score, name, row_number() over (partition by doc_id order by score desc, name) as r, count(*) over (partition by doc_id) as k from dice where score >= {t})
select d.doc_id, h.name as license, round(h.score, 6) as score, coalesce(h.k, 0)::bigint as n_matches
from documents d left join hit h on h.doc_id = d.doc_id and h.r = 1
"""

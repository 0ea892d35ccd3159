"""License scans by template markup.

A template is wording with [[optional]] regions and {{n}} regions that any words, n at most, may replace. Templates
compile to one token automaton (states are sets of places, made as they are first met), which runs from each word that
begins one. A place is accepted where all mandatory words stand in order, with nothing else but what the regions allow.
Plain phrases are templates without regions.

Null texts are empty: no words, no labels. Places may overlap, and all are counted. Rows are scanned one by one:
repeated rows give equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import LOWER, UPPER, map_batches, table, text_or_empty, utf8

#: Phrases that name a license, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices, and the wording of short licenses.
NOTICES = {
    "gpl-3.0-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[or later]]",
    "gpl-2.0-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[or later]]",
    "gpl-3.0-header": "this {{3}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2.0-header": "this {{3}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-notice": "licensed under the [[terms of the]] apache license version 2 0 [[the license]]",
    "cc-by-4.0-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0 [[international]] [[license]]",
    "cc-by-nc-4.0-notice": "licensed under [[a]] [[the]] cc by nc 4 0 [[international]] [[license]]",
    "cc-by-sa-4.0-notice": "licensed under [[a]] [[the]] cc by sa 4 0 [[international]] [[license]]",
    "mit-notice": "released under the [[terms of the]] mit license",
}
TEXTS = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "0bsd-text": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}

#: How much a match of each kind says: a phrase names a license, a notice grants it, a text is it.
WEIGHT = {"phrase": 0.5, "notice": 0.8, "text": 1.0}

#: Bytes that are no word bytes become spaces, A-Z become a-z.
WORD_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """Nodes are places in templates: (word or None for any, next places). A state is the frozenset of nodes that may
    read the next word, with the templates that end before it."""

    def __init__(self, templates: dict[str, str]):
        self.reads: list[bytes | None] = []
        self.then: list[set[int]] = []
        self.ends: dict[int, str] = {}
        self.first: set[int] = set()
        for label, markup in templates.items():
            end = self.node(None)
            self.ends[end] = label
            parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup.lower())
            self.first |= self.compile(parts, {end})
        self.words = {self.reads[n] for n in self.first if n not in self.ends}
        if None in self.words:
            raise ValueError("a template begins with a replaceable region")
        self.known = {x for x in self.reads if x is not None}
        self.states: dict[frozenset[int], tuple[dict[bytes | None, frozenset[int]], list[str]]] = {}
        self.start = frozenset(self.first)

    def node(self, word: bytes | None) -> int:
        self.reads.append(word)
        self.then.append(set())
        return len(self.reads) - 1

    def compile(self, parts: list[str], after: set[int]) -> set[int]:
        """Nodes that may come first in parts, if the nodes in after may follow them."""
        depth, i = 0, len(parts)
        while i:
            i -= 1
            if parts[i] == "]]":
                depth, j = 1, i
                while depth:
                    j -= 1
                    depth += (parts[j] == "]]") - (parts[j] == "[[")
                after = self.compile(parts[j + 1 : i], after) | after
                i = j
            elif parts[i].startswith("{{"):
                for _ in range(int(parts[i][2:-2])):
                    n = self.node(None)
                    self.then[n] = set(after)
                    after = after | {n}
            else:
                n = self.node(parts[i].encode())
                self.then[n] = set(after)
                after = {n}
        return after

    def state(self, nodes: frozenset[int]) -> tuple[dict[bytes | None, frozenset[int]], list[str]]:
        if nodes not in self.states:
            live = [n for n in nodes if n not in self.ends]
            steps: dict[bytes | None, frozenset[int]] = {}
            for word in {self.reads[n] for n in live} | {None}:
                steps[word] = frozenset(x for n in live if self.reads[n] in (word, None) for x in self.then[n])
            self.states[nodes] = steps, sorted({self.ends[n] for n in nodes if n in self.ends})
        return self.states[nodes]

    def places(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, word after the last) of each accepted place; of one label and start, the longest."""
        if self.words.isdisjoint(words):
            return []
        found: dict[tuple[str, int], int] = {}
        for at in [i for i, w in enumerate(words) if w in self.words]:
            nodes, i = self.start, at
            while nodes:
                steps, ended = self.state(nodes)
                for label in ended:
                    found[label, at] = i
                if i == len(words):
                    break
                nodes = steps.get(words[i], steps[None])
                i += 1
        return [(label, at, end) for (label, at), end in found.items()]


def default_templates() -> dict[str, str]:
    return {label: phrase for phrase, label in PHRASES.items()} | NOTICES | TEXTS


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places: array of (label, start, end) in words. Templates are label -> markup."""
    given = templates or default_templates()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        automaton = Automaton(given)
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, places = [], []
            for text in utf8(batch.column(1)):
                words = words_of(text)
                counts.append(len(words))
                places.append([{"label": x, "start": a, "end": b} for x, a, b in sorted(automaton.places(words), key=lambda x: (x[1], x[0]))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, kind)], names=["doc_id", "n_words", "places"])

        return one

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(few, make, "doc_id long, n_words long, places array<struct<label string, start long, end long>>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda x: x.label.isin(list(PHRASES.values())))
    weight = F.create_map(*(F.lit(x) for label in default_templates() for x in (label, WEIGHT["phrase" if label in PHRASES.values() else "text" if label in TEXTS else "notice"])))
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x.label))), ",")
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x.start)).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x.start)).alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: F.element_at(weight, x.label))), F.lit(0.0)).alias("score"),
    )


def template_pattern(markup: str) -> str:
    """The template as a regular expression over words that each follow a blank, with a blank at the end."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup.lower()):
        out += {"[[": "(?:", "]]": ")?"}.get(part) or (f"(?: [^ ]+){{0,{part[2:-2]}}}" if part.startswith("{{") else f" {part}")
    return out + " "


def oracle_sql() -> str:
    found = ", ".join(f"case when regexp_matches(t, '{template_pattern(markup)}') then '{label}' end" for label, markup in default_templates().items())
    score = "greatest(0.0, " + ", ".join(f"case when regexp_matches(t, '{template_pattern(markup)}') then {WEIGHT['phrase' if label in PHRASES.values() else 'text' if label in TEXTS else 'notice']} else 0.0 end" for label, markup in default_templates().items()) + ")"
    places = " || ".join(f"list_filter(range(0, len(words) - {len(p.split()) - 1}), lambda i: words[i + 1:i + {len(p.split())}] = {p.split()!r})" for p in PHRASES)
    names = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x is not null))), ',')"
    base = "[" + ", ".join(f"case when regexp_matches(t, '{template_pattern(p)}') then '{label}' end" for p, label in PHRASES.items()) + "]"
    return f"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') words from documents),
p as (select doc_id, words, ' ' || array_to_string(words, ' ') || ' ' t, {places} places from d)
select doc_id, cast(len(words) as bigint) n_words, cast(len(places) as bigint) n_base, list_min(places) first_word, list_max(places) last_word, {names.format(base)} base_labels, {names.format("[" + found + "]")} labels, cast({score} as double) score from p
"""

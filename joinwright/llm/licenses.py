"""Licence scans with a positional index of rare words.

A licence has templates: short names, and sentences of its text or its notice.
Each template is a word sequence with mandatory key phrases. One pass over the
texts writes the places of all words that templates use (but for the most
common ones, which a template is told apart without); document frequencies are
counted from what was written. The index holds, for each template, postings
(word, template, position) of its rarest words by inverse document frequency.
The places of these words are looked up in it; postings that agree on where the
template would begin, give or take ``SLACK`` words where it may be altered, are
put together, and where their weight suffices the template is a candidate. No
one word is mandatory. The words around a candidate are then held against the
whole template: enough of them must stand near their place, and every key
phrase must be whole. A name allows no slack and is all key phrase, so it is
found wherever its words stand consecutively.

Built-in functions only. Defined cases: a null text counts as empty; rows keep
their ids, null or repeated; repeated rows stay repeated; a very long text is
one array of words in its task, and its places are grouped by stretches of 64
words, not by text; overlapping places each count, and of places of one
template that begin within ``SLACK`` words the best is listed (ties to the
first); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinwright.llm.workspace import Workspace

#: What stands between words.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Words that are in every text; names may hold them, key phrases do not.
COMMON = frozenset("a all an and any are as at be but for from if in is it its may no not of on or such that the their they this to was with you your".split())


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def name(self) -> bool:
        """Without key phrases of its own a template is one."""
        return not self.keys


#: The base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: Names of public licences, in words.
NAMES = (
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsl", "boost software license"),
)
#: Sentences of public licences and notices, in words, with the phrases that must be whole.
SENTENCES = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted",)),
    Template("mit-text", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("without restriction", "merge publish distribute")),
    Template("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice", "substantial portions")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("binary forms",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("source code must retain",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("binary form must reproduce",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("prior written permission",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("without fee", "hereby granted")),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("licensed under", "apache license version 2 0")),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("applicable law", "warranties")),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software foundation",)),
    Template("gpl-text", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("implied warranty", "particular purpose")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form", "mozilla public license")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("compiled binary",)),
    Template("cc-by-text", "this work is licensed under a creative commons attribution international license", ("creative commons attribution",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("held liable",)),
)
TEXTS = NAMES + SENTENCES
#: Postings of a template; part of their weight, and of its words, that a place must have.
RARE, WEIGHT, COVER = 8, 0.4, 0.7
#: Words by which a word of a sentence may stand off its place against where the sentence begins; words of a stretch.
SLACK, STRETCH = 6, 64
PLACE = "array<struct<start:int,label:string,base:boolean,score:double>>"


def _told(t: Template) -> list[tuple[int, str]]:
    """(position, word) of what a template is told apart by: all words of a name, else those that are not common."""
    return [(i, w) for i, w in enumerate(t.words.split()) if t.name or w not in COMMON]


def word_places(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_words, hits): one row for each of ``docs``; hits has (pos, word) of the known words, in lower case.

    A word's letters are plain, so one of other letters that lower() maps to them is longer in bytes.
    """
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), GAP, -1)
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("words"))
    lead, trail = (F.element_at("words", i) == "" for i in (1, -1))  # a gap at an end leaves an empty string there
    n = F.size("words") - lead.cast("int") - (trail & (F.size("words") > 1)).cast("int")

    def known(at: Column) -> Column:
        own = F.get("words", at)
        return F.lower(own).isin(vocabulary) & (F.octet_length(own) == F.length(own))

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), known)
    hits = F.transform(places, lambda at: F.struct((at - lead.cast("int")).alias("pos"), F.lower(F.get("words", at)).alias("word")))
    return read.select("row", "id", n.cast("long").alias("n_words"), hits.alias("hits"))


def frequency_weights(read: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of the templates' words (one row for each to the driver)."""
    found = F.array_distinct(F.transform("hits", lambda h: h["word"]))
    rows = read.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = read.count()
    count = {r.word: r.n for r in rows}
    return {w: log((n + 1) / (count.get(w, 0) + 0.5)) for w in vocabulary}


def _stretches(first: Column, last: Column) -> Column:
    cut = lambda c: F.floor(F.greatest(c, F.lit(0)) / STRETCH)
    return F.sequence(cut(first), F.greatest(cut(first), cut(last)))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places): places has (start, label, base, score) for each place that stands."""
    spark = docs.sparkSession
    work = Workspace(spark, "licenses")
    vocabulary = sorted({w for t in templates for _, w in _told(t)} | {w for t in templates for k in t.keys for w in k.split()})
    read = work.write(word_places(docs, vocabulary, id_col, text_col), "hits")
    idf = frequency_weights(read, vocabulary)
    hits = read.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.pos", "hit.word")
    postings, facts = [], []
    for k, t in enumerate(templates):
        told = _told(t)
        rare = sorted(told, key=lambda x: (-idf[x[1]], x[0]))[:RARE]
        total = sum(idf[w] for _, w in rare) or 1.0
        postings += [(w, k, i, 0 if t.name else SLACK, idf[w] / total) for i, w in rare]
        facts.append((k, t.label, t.base, len(t.words.split()), 0 if t.name else 2 * SLACK, [{"at": i, "word": w} for i, w in told], [x.split() for x in t.keys]))
    index = spark.createDataFrame(postings, "word string, template int, offset int, slack int, weight double")
    known = spark.createDataFrame(facts, "template int, label string, base boolean, length int, off int, told array<struct<at:int,word:string>>, keys array<array<string>>")

    # postings that agree on the beginning: exactly, or inside one of the half-overlapping bins of two slacks
    looked = hits.join(F.broadcast(index), "word").withColumn("start", F.col("pos") - F.col("offset"))
    half = F.floor(F.col("start") / SLACK).cast("int")
    looked = looked.withColumn("begin", F.explode(F.when(F.col("slack") == 0, F.array("start")).otherwise(F.array(half * SLACK, (half - 1) * SLACK))))
    found = F.collect_set(F.struct("offset", "weight"))  # RARE entries at most
    candidates = looked.groupBy("row", "template", "begin").agg(found.alias("found"))
    candidates = candidates.where(F.aggregate("found", F.lit(0.0), lambda acc, x: acc + x["weight"]) >= WEIGHT).select("row", "template", "begin")
    candidates = candidates.join(F.broadcast(known), "template").withColumn("middle", F.col("begin") + F.floor(F.col("off") / 2).cast("int"))
    first, last = F.col("middle") - F.col("off"), F.col("middle") + F.col("length") + F.col("off")
    near = candidates.select("row", "template", "begin", first.alias("first"), last.alias("last"), F.explode(_stretches(first, last)).alias("stretch"))
    near = near.join(hits.select("row", "pos", "word", F.floor(F.col("pos") / STRETCH).alias("stretch")), ["row", "stretch"]).where("pos >= first AND pos < last")
    near = near.groupBy("row", "template", "begin").agg(F.collect_list(F.struct("pos", "word")).alias("seen"))  # a window's words at most

    placed = near.join(F.broadcast(known), "template").withColumn("middle", F.col("begin") + F.floor(F.col("off") / 2).cast("int"))
    at_place = lambda x: F.exists("seen", lambda s: (s["word"] == x["word"]) & (F.abs(s["pos"] - x["at"] - F.col("middle")) <= F.col("off")))
    stands = lambda key, s: F.forall(F.sequence(F.lit(0), F.size(key) - 1), lambda i: F.array_contains("seen", F.struct((s["pos"] + i).alias("pos"), F.element_at(key, i + 1).alias("word"))))
    whole = F.forall("keys", lambda key: F.exists("seen", lambda s: stands(key, s)))
    score = F.size(F.filter("told", at_place)) / F.size("told")
    least = F.when(F.size("keys") == 0, F.lit(1.0)).otherwise(F.lit(COVER))
    begins = F.array_min(F.transform(F.filter("told", at_place), lambda x: F.array_min(F.transform(F.filter("seen", lambda s: (s["word"] == x["word"]) & (F.abs(s["pos"] - x["at"] - F.col("middle")) <= F.col("off"))), lambda s: s["pos"]))))
    start = F.when(F.size("keys") == 0, F.col("begin")).otherwise(begins)
    placed = placed.where("begin >= 0 OR off > 0").withColumn("score", score).where(whole & (F.col("score") >= least)).select("row", "template", "label", "base", "off", start.alias("start"), "score")
    # neighbouring bins tell of one place
    again = Window.partitionBy("row", "template", F.when(F.col("off") == 0, F.col("start"))).orderBy("start", F.desc("score"))
    placed = placed.withColumn("before", F.lag("start").over(again)).withColumn("new", F.when((F.col("off") > 0) & (F.col("start") - F.col("before") <= SLACK), 0).otherwise(1))
    placed = placed.withColumn("place", F.sum("new").over(again.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.groupBy("row", "template", "label", "base", "place", F.when(F.col("off") == 0, F.col("start")).alias("exact")).agg(F.max("score").alias("score"), F.min("start").alias("start"))
    places = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "label", "base", "score"))).alias("places"))
    return read.select("row", "id", "n_words").join(places, "row", "left").select("id", "n_words", F.coalesce("places", F.array().cast(PLACE)).alias("places"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan_licenses(docs, id_col=id_col, text_col=text_col)
    base = F.filter("places", lambda p: p["base"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    return found.select(
        "id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )

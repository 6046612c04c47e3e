"""License scans: text blocks that contain a license template, by an exact set-similarity join.

Templates and blocks are sets of words, numbered from the rarest in the whole corpus to the most
frequent. A block contains a template if it has at least the share `least` of the template's
words. If so, their first common word stands early in both: prefix and positional filters test
just that, the length filter drops blocks with too few words of any template, and what is left is
compared whole. Blocks are windows twice as long as the longest template of a size class, and
start every half of that, so any place that a template could fill lies within one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_lists, slices, stage
from .decontaminate import words_of

#: A block has this share of a template's words. Below twenty words that is all of them, so that licenses which differ by a word or a number stay apart.
#: For the same reason no template's words are all among another's.
LEAST = 0.95
#: Templates are a table that every task holds; beyond this many words in all they are refused.
MOST_WORDS = 1 << 20

# The phrases of the contract, and public license statements and notices.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [
    ("agpl-3", "Licensed under the terms of the GNU Affero General Public License, version 3"),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "Licensed under the terms of the GNU Lesser General Public License, version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def least_common(size: int, least: float) -> int:
    """How many of a template's words a block needs; rounded first, so that 0.95 of 20 is 19."""
    return max(1, math.ceil(round(size * least, 9)))


class Templates:
    """Templates as sorted numbers of their words, the rarest first, with what a task needs to cut blocks.

    counts: how often each word occurs in the corpus; words without a count are the rarest. Words
    of equal counts are ordered by themselves.
    """

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], least: float = LEAST):
        if not 0 < least <= 1:
            raise ValueError("the least share of a template is over 0 and at most 1")
        texts = [(label, words_of(text.encode())) for label, text in templates]
        texts = [(label, w) for label, w in texts if w]
        if sum(len(w) for _, w in texts) > MOST_WORDS:
            raise ValueError(f"templates of over {MOST_WORDS} words don't fit into every task")
        vocabulary = {x for _, w in texts for x in w}
        order = sorted(vocabulary, key=lambda x: (counts.get(x.decode(), 0), x))
        self.number = {x: k for k, x in enumerate(order)}
        #: (size class, label, numbers, words needed)
        self.rows = []
        for label, w in texts:
            numbers = sorted({self.number[x] for x in w})
            self.rows.append((1 << max(2, (len(w) - 1).bit_length()), label, numbers, least_common(len(numbers), least)))
        #: By size class: the fewest words that a template needs, and the words of templates' prefixes.
        self.fewest, self.prefix = {}, {}
        for half, _, numbers, need in self.rows:
            self.fewest[half] = min(need, self.fewest.get(half, need))
            self.prefix.setdefault(half, set()).update(numbers[: len(numbers) - need + 1])

    def blocks(self, words: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """(size class, start, numbers) of the blocks of a text that hold a word of a template's prefix, and enough words of templates."""
        numbers = np.fromiter((self.number.get(w, -1) for w in words), "int32", len(words))
        places = np.flatnonzero(numbers >= 0)
        known, found = numbers[places], []
        if not len(places):
            return found
        for half, prefix in self.prefix.items():
            rare = places[np.isin(known, list(prefix))]
            first = np.maximum(0, rare // half - 1)
            starts = np.unique(np.concatenate([first, rare // half])) * half
            ends = np.searchsorted(places, starts + 2 * half)
            for start, a, b in zip(starts.tolist(), np.searchsorted(places, starts).tolist(), ends.tolist(), strict=True):
                own = np.unique(known[a:b])
                if len(own) >= self.fewest[half]:
                    found.append((half, start, own.tolist()))
        return found

    def prefixes(self, spark: SparkSession) -> DataFrame:
        """token, half, template, i, size, need, words: a row for each word of each template's prefix."""
        rows = [(x, half, label, i, len(numbers), need, numbers) for half, label, numbers, need in self.rows for i, x in enumerate(numbers[: len(numbers) - need + 1])]
        return spark.createDataFrame(rows, "token int, half int, template string, i int, size int, need int, words array<int>")


def word_counts(docs: DataFrame, wanted: set[bytes]) -> dict[str, int]:
    """How often each wanted word occurs in all texts: a row for each task and word is added up."""

    def count(batches):
        sums: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, 1000):
                for text in byte_lists(part, "text"):
                    for w in words_of(text):
                        if w in wanted:
                            sums[w] = sums.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in sums], "string"), "n": pa.array(list(sums.values()), "int64")})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in rows.collect()}  # at most the words of the templates


def phrase_places(words: list[bytes], phrases: list[tuple[str, list[bytes]]]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively, overlapping ones too."""
    line, found = b" " + b" ".join(words) + b" ", []
    for label, phrase in phrases:
        wanted = b" " + b" ".join(phrase) + b" "
        at = line.find(wanted)
        while at >= 0 and phrase:
            found.append((line.count(b" ", 0, at), label))
            at = line.find(wanted, at + 1)
    return found


SCANNED = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<half:int,start:int,words:array<int>>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]], phrases: list[tuple[str, str]] = PHRASES, least: float = LEAST) -> tuple[DataFrame, Templates]:
    """SCANNED, a row for each row of docs (doc_id, text), written to the shared folder, and the numbered templates.

    Texts are read twice: for the counts that order the words, and for the blocks. Blocks without a
    word of a template's prefix never leave the task.
    """
    words = {w for _, text in templates for w in words_of(text.encode())}
    numbered = Templates(templates, word_counts(docs, words), least)
    looked = [(label, words_of(text.encode())) for label, text in phrases]

    def rows(batches):
        n = 0
        task = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 500):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), byte_lists(part, "text"), strict=True):
                    w = words_of(text)
                    places = phrase_places(w, looked)
                    at = [k for k, _ in places]
                    blocks = [{"half": h, "start": s, "words": x} for h, s, x in numbered.blocks(w)]
                    out.append((task + n, doc_id, len(w), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places}), blocks))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = [x.split()[0] for x in SCANNED.split(", ")]
    kinds = [*[pa.int64()] * 6, pa.list_(pa.string()), pa.list_(pa.struct([("half", pa.int32()), ("start", pa.int32()), ("words", pa.list_(pa.int32()))]))]
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCANNED), "license-scan"), numbered


def license_blocks(scanned: DataFrame, numbered: Templates) -> DataFrame:
    """row, doc_id, template, start, words_in_block, containment of every block that meets the threshold.

    The join is on the words of both prefixes; a pair is kept where its common word leaves enough
    words on both sides, and then compared whole. Templates go to every task, MOST_WORDS of them at most.
    """
    fewest = F.create_map(*[F.lit(x) for pair in numbered.fewest.items() for x in pair]) if numbered.fewest else F.create_map(F.lit(0), F.lit(1))
    blocks = scanned.select("row", "doc_id", F.explode("blocks").alias("b")).select("row", "doc_id", "b.*").withColumnRenamed("words", "held")
    keys = blocks.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - fewest[F.col("half")] + 1)).alias("j", "token"))
    met = keys.join(F.broadcast(numbered.prefixes(scanned.sparkSession)), ["half", "token"])  # size checked in Templates
    near = met.where((F.col("size") - F.col("i") >= F.col("need")) & (F.size("held") - F.col("j") >= F.col("need")))
    common = near.withColumn("common", F.size(F.array_intersect("held", "words"))).where(F.col("common") >= F.col("need"))
    return common.select("row", "doc_id", "template", "start", F.size("held").alias("words_in_block"), (F.col("common") / F.col("size")).alias("containment")).distinct()


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of docs.

    score: 1 where a phrase stands, else the largest containment of a template found, else 0. A
    null text has no words; repeated rows and null ids have rows of their own.
    """
    scanned, numbered = scan(docs, templates, phrases, least)
    found = license_blocks(scanned, numbered).groupBy("row").agg(F.collect_set("template").alias("more"), F.max("containment").alias("best"))
    joined = scanned.drop("blocks").join(found, "row", "left")
    none = F.array().cast("array<string>")
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", line(F.col("base")).alias("base_labels"),
        line(F.concat("base", F.coalesce("more", none))).alias("labels"), score.alias("score"),
    )

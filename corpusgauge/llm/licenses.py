"""License scan by an exact set-similarity join of text blocks with license templates.

A text is a row of words. Blocks of twice a template's length, at steps of its length, cover every passage a template can
take, so a passage lies whole in one block whatever surrounds it. A block meets a template if it holds at least the
threshold's share of the template's distinct words. The join finds all such pairs:

* words are ordered by the number of documents of the corpus that hold them, rarest first;
* prefix filter: with `need` words to share, one of the first |T| - need + 1 words of the template is shared, and it is
  among the first |B| - need + 1 words of the block (of those that templates know);
* length filter: a block knows at least `need` of the templates' words;
* positional filter: after the first shared word enough words are left on both sides;
* what is left is compared word by word.

Fixed phrases are told apart from this: every place where their words stand in a row. One pass reads the texts; all else
works on a few numbers per document and the blocks that pass the length filter. Templates are a parameter of bounded size.
"""

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

# Phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label and text of statements and notices in common use.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by "
                 "any means without the prior written permission of the publisher"),
)
THRESHOLD = 0.9
#: Most distinct words of all templates together: they are sent to every task.
MOST_WORDS = 1 << 17

#: Bytes that end a word become blanks, A-Z small; bytes from 0x80 on belong to words.
SMALL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())
SCANNED = ("row long, doc_id long, n_words long, places array<struct<label:string,start:long>>, "
           "blocks array<struct<scale:int,start:long,words:array<int>>>, word int, n_docs long")
FOUND = "array<struct<label:string,start:bigint,end:bigint,score:double>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(SMALL).split()


class Templates:
    """Templates with numbered words: per template its label, scale (block step), words and how many must be shared."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold is above 0 and at most 1")
        self.numbers: dict[bytes, int] = {}
        self.each: list[tuple[str, int, frozenset, int]] = []
        for label, text in templates:
            words = words_of(text.encode())
            if words:
                own = frozenset(self.numbers.setdefault(w, len(self.numbers)) for w in words)
                scale = 1 << max(2, (len(words) - 1).bit_length())
                self.each.append((label, scale, own, least_shared(len(own), threshold)))
        if len(self.numbers) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} distinct words")
        #: Scale to its templates' words and the least number that one of them must share.
        self.scales = {s: (frozenset().union(*(t[2] for t in self.each if t[1] == s)), min(t[3] for t in self.each if t[1] == s))
                       for s in sorted({t[1] for t in self.each})}


def least_shared(size: int, threshold: float) -> int:
    return max(1, ceil(size * threshold - 1e-9))


def places(words: list[bytes], held: set[bytes], phrases) -> list[dict]:
    """Where a phrase's words stand in a row."""
    out = []
    for parts, label in phrases:
        if held.issuperset(parts):
            at, most = -1, len(words) - len(parts)
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if at <= most and words[at : at + len(parts)] == parts:
                    out.append({"label": label, "start": at})
    return out


def blocks_of(known: list[tuple[int, int]], scales: dict) -> list[dict]:
    """Blocks that know enough of the templates' words; known: (place, number) of those words in the text."""
    out = []
    for scale, (vocabulary, least) in scales.items():
        sets: dict[int, set] = {}
        for at, number in known:
            if number in vocabulary:
                k = at // scale
                sets.setdefault(k, set()).add(number)
                if k:
                    sets.setdefault(k - 1, set()).add(number)
        out += [{"scale": scale, "start": k * scale, "words": sorted(own)} for k, own in sets.items() if len(own) >= least]
    return out


def scanned(docs: DataFrame, text: str, key: str, templates: Templates, phrases) -> DataFrame:
    """A row per document with its places and blocks, and rows (word, n_docs) that count the templates' words."""
    numbers, scales = templates.numbers, templates.scales
    phrases = [(words_of(p.encode()), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        schema = pa.schema([
            ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
            ("blocks", pa.list_(pa.struct([("scale", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int32()))]))),
            ("word", pa.int32()), ("n_docs", pa.int64())])
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(value.as_py() or b"")
                held = set(words)
                some = held & numbers.keys()
                for w in some:
                    counts[numbers[w]] = counts.get(numbers[w], 0) + 1
                own = {numbers[w] for w in some}
                fit = {s: x for s, x in scales.items() if len(own & x[0]) >= x[1]}
                known = [(i, numbers[w]) for i, w in enumerate(words) if w in some] if fit else []
                out.append({"row": row, "doc_id": doc_id, "n_words": len(words), "places": places(words, held, phrases),
                            "blocks": blocks_of(known, fit)})
                row += 1
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist([{"word": w, "n_docs": n} for w, n in sorted(counts.items())], schema)

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text"))
    return rows.mapInArrow(run, SCANNED)


def joined(blocks: DataFrame, templates: Templates, counts: dict[int, int]) -> DataFrame:
    """(row, label, start, end, score) of each block (row, scale, start, words) and template that meet."""
    spark = blocks.sparkSession
    order = {w: i for i, w in enumerate(sorted(templates.numbers.values(), key=lambda w: (counts.get(w, 0), w)))}
    kept, prefixes = [], []
    for i, (label, scale, words, need) in enumerate(templates.each):
        ranks = sorted(order[w] for w in words)
        kept.append((i, label, ranks, need))
        prefixes += [(scale, rank, i, at, len(ranks), need) for at, rank in enumerate(ranks[: len(ranks) - need + 1])]
    # Both have at most MOST_WORDS words in all, checked when the templates were made.
    kept = F.broadcast(spark.createDataFrame(kept, "template int, label string, ranks array<int>, need int"))
    prefixes = F.broadcast(spark.createDataFrame(prefixes, "scale int, rank int, template int, at int, size int, need int"))
    by_word = F.broadcast(spark.createDataFrame(sorted(order.items()), "word int, rank int"))

    least = F.create_map(*[F.lit(x) for s, (_, n) in templates.scales.items() for x in (s, n)])
    ranked = blocks.select("row", "scale", "start", F.explode("words").alias("word")).join(by_word, "word")
    ranked = ranked.groupBy("row", "scale", "start").agg(F.sort_array(F.collect_list("rank")).alias("own"))
    known = F.size("own")
    head = F.slice("own", 1, known - least[F.col("scale")] + 1)
    met = ranked.select("row", "scale", "start", "own", F.posexplode(head).alias("place", "rank")).join(prefixes, ["scale", "rank"])
    met = met.filter(known >= F.col("need"))
    first = met.groupBy("row", "scale", "start", "template", "size", "need").agg(
        F.min(F.struct("place", "at")).alias("m"), F.first("own").alias("own"))
    left = F.least(known - F.col("m.place"), F.col("size") - F.col("m.at"))
    first = first.filter(left >= F.col("need")).drop("need")
    shared = F.size(F.array_intersect("own", "ranks"))
    return first.join(kept, "template").filter(shared >= F.col("need")).select(
        "row", "label", "start", (F.col("start") + 2 * F.col("scale")).alias("end"), (shared / F.col("size")).alias("score"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD,
         phrases=PHRASES) -> DataFrame:
    """Per row of docs: doc_id, n_words, places (label, start of each phrase found) and blocks (label, start, end, score).

    Words are numbered from 0; a block is start to end (exclusive, at most n_words); score is the share of the template's
    distinct words in it. All blocks that meet a template are told. Null texts are empty and hold nothing; a null key
    stays null; repeated rows give repeated rows; other columns of docs are left out.
    """
    made = Templates(templates, threshold)
    rows = written(scanned(docs, text, key, made, phrases), "licenses")
    counted = rows.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n_docs").alias("n"))
    counts = {r["word"]: r["n"] for r in counted.collect()}  # at most MOST_WORDS rows
    rows = rows.filter(F.col("row").isNotNull()).drop("word", "n_docs")
    blocks = rows.filter(F.size("blocks") > 0).select("row", F.inline("blocks"))
    found = joined(blocks, made, counts).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("label", "start", "end", "score"))).alias("found"))
    none = F.array().cast(FOUND)
    whole = F.transform(F.coalesce("found", none), lambda b: b.withField("end", F.least(b["end"], F.col("n_words"))))
    return rows.join(found, "row", "left").select("doc_id", "n_words", F.array_sort("places").alias("places"), whole.alias("blocks"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and labels of what scan() gives. score: 1 where a phrase stands, else the best block's share, else 0."""
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best: Column = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.transform("blocks", lambda b: b["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"), F.size("blocks").cast("long").alias("n_blocks"))

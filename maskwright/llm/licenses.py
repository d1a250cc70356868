"""License scans: exact set-similarity join of text blocks with license templates, prefix, length and position filtered."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import id_and_text, public_id, words_of

#: Phrases whose words must stand consecutively, and the label that each proves.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further templates: a block that contains THRESHOLD of a template's distinct words gets its label.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
THRESHOLD = 0.9


class Template:
    def __init__(self, text: str, label: str, threshold: float, phrase: bool):
        self.words, self.label, self.phrase = text.split(), label, phrase
        self.tokens = sorted(set(self.words))
        self.need = len(self.tokens) if phrase else math.ceil(threshold * len(self.tokens) - 1e-9)


def templates(threshold: float = THRESHOLD, extra: list[tuple[str, str]] = TEMPLATES) -> list[Template]:
    return [Template(t, k, threshold, True) for t, k in PHRASES.items()] + [Template(t, k, threshold, False) for t, k in extra]


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, extra: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, blocks): where license phrases stand and which blocks contain a template.

    places: (start, label) of each phrase, words from 0. blocks: (start, label, score) for each block of words that
    holds at least the threshold of a template's distinct words; score is the share held. Blocks are runs of twice the
    longest template's words, one starting at every such length, so that each place lies in a block as a whole. Null texts are
    empty. A null doc_id stays; rows that share a doc_id count as one document, the one of least text. Extra columns
    are not read. An empty table gives no rows.

    Words are ordered by the number of documents that hold them, counted over all documents for the templates' words
    (the others are in no intersection); a template is indexed by its rarest words. Only documents with such a word
    are cut into blocks. Templates are a fixed list, so the index that is joined has a fixed size.
    """
    spark = docs.sparkSession
    known = templates(threshold, extra)
    vocabulary = sorted({w for t in known for w in t.tokens})
    stride = max(len(t.words) for t in known)
    base = id_and_text(docs)
    counted = base.select(F.explode(F.array_intersect(words_of(F.col("text")), _strings(vocabulary))).alias("w")).groupBy("w").count()
    held = {r["w"]: r["count"] for r in counted.collect()}
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for n, t in enumerate(known):
        ordered = sorted(t.tokens, key=rank.__getitem__)
        for i, w in enumerate(ordered[: len(ordered) - t.need + 1]):
            index.append((w, n, t.label, t.phrase, t.words, ordered, len(ordered), t.need, i))
    prefix = spark.createDataFrame(index, "token string, template int, label string, phrase boolean, words array<string>, tokens array<string>, n int, need int, i int")
    rare = sorted({x[0] for x in index})

    words = base.select("id", words_of(F.col("text")).alias("w")).select("id", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", _strings(rare)), F.col("w")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(stride))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(F.col("w"), s + 1, 2 * stride).alias("words")))
    blocks = words.select("id", "n_words", F.explode_outer(F.when(F.col("w").isNotNull(), cut)).alias("b"))
    tokens = blocks.select("id", "n_words", "b", F.array_intersect(_strings(order), F.col("b.words")).alias("have"))
    # only a template's rarest words are in the index, so only those of a block are looked up there
    placed = F.transform("have", lambda w, j: F.struct(j.alias("j"), w.alias("token")))
    probes = tokens.select("id", "n_words", "b", "have", F.explode_outer(F.filter(placed, lambda x: x["token"].isin(rare))).alias("x")).select("id", "n_words", "b", "have", "x.j", "x.token")
    joined = probes.join(F.broadcast(prefix), "token", "left")
    fits = 1 + F.least(F.col("n") - F.col("i") - 1, F.size("have") - F.col("j") - 1) >= F.col("need")
    shared = F.size(F.array_intersect("tokens", "have"))
    kept = F.when(fits & (shared >= F.col("need")), shared / F.col("n"))
    here = F.filter(F.sequence(F.lit(0), F.greatest(F.size("b.words") - F.size("words"), F.lit(0))), lambda p: F.slice(F.col("b.words"), p + 1, F.size("words")) == F.col("words"))
    places = F.transform(here, lambda p: F.struct((p + F.col("b.start")).cast("long").alias("start"), F.col("label").alias("label")))
    verified = joined.select(
        "id",
        "n_words",
        F.when(kept.isNotNull() & F.col("phrase"), places).alias("places"),
        F.when(kept.isNotNull() & ~F.col("phrase"), F.struct(F.col("b.start").cast("long").alias("start"), "label", kept.alias("score"))).alias("block"),
    )
    return verified.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("places"),
        F.array_sort(F.collect_set("block")).alias("blocks"),
    ).select(public_id().alias("doc_id"), "n_words", "places", "blocks")

"""License scans: a positional index of the rarest words of license texts.

Words of the license texts get their inverse document frequency over the whole corpus.  Each template keeps its
``RARE`` rarest words, and a file is looked at where it holds one of these.  The places of all the file's rare license
words and words of key phrases (the templates bound how many words these are) meet the templates' postings; hits with the same distance between
place and template place belong to one occurrence of the template.  An occurrence counts where its rare words weigh
enough and all words of the template's mandatory key phrase stand in their places.

``BASE`` phrases are counted besides, at all places.

Defined results: a null text counts as empty; no words, no labels, score 0.  Repeated rows are judged alike; one row per
input row, none for an empty table.  Long texts are searched whole.  Templates that fit equally well are all reported.
Further columns are ignored, whatever their names.  A word inserted inside a notice shifts what follows; the occurrence then rests on the words of one side.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, slim, text_key

# Phrases and labels of the plain count.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Label, notice, mandatory key phrase (its words stand next to each other in the notice).
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public license"),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "gnu lesser general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache license"),
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
    ("cc0", "released under the CC0 1.0 Universal Public Domain Dedication", "cc0 1 0 universal"),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd"),
)
#: Rarest words kept of each template.
RARE = 4
#: Share of a template's rare weight that an occurrence needs.
ENOUGH = 0.6
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a short ASCII text."""
    return re.findall(r"[0-9a-z]+", text.lower())


def _joined(text: Column) -> Column:
    """The words with one space before, between and behind them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, _UPPER, _LOWER), F.lit(" ")), _NOT_WORD, " ")


def document_frequency(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the templates.  The driver gets a row for each such word."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in words_of(t)})
    words = F.split(F.regexp_replace(F.lower("text"), _NOT_WORD, " "), " ")
    known = F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))
    held = docs.select(F.explode(F.array_append(F.coalesce(known, F.array().cast("array<string>")), F.lit(""))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.pop("", 0), found


def _templates(n: int, df: dict[str, int]) -> list[dict]:
    """Word lists, rare places with their weights, and the mask of the key phrase's places."""
    out = []
    for number, (label, text, key) in enumerate(TEMPLATES):
        words, phrase = words_of(text), words_of(key)
        idf = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in words}
        at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
        # words that tell templates apart stand in the key phrase; ties by word
        rare = sorted(set(words), key=lambda w: (-idf[w], w not in phrase, w))[:RARE]
        out.append({"template": number, "label": label, "words": words, "idf": idf, "rare": set(rare),
                    "key": sum(1 << k for k in range(at, at + len(phrase))), "key_words": set(phrase)})
    return out


def _literal(spark, rows: list[tuple], names: list[str], kinds: list[str]) -> DataFrame:
    """A small table out of literals, made by the JVM."""
    cells = [F.struct(*[F.lit(v).cast(k).alias(c) for v, c, k in zip(r, names, kinds, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def _phrase_counts(joined: Column) -> list[Column]:
    """n_base, first_word, last_word, base_labels of a text's joined words."""
    places, firsts, lasts, labels = [], [], [], []
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    backwards = F.reverse(joined)
    for phrase, label in BASE:
        n_words = len(phrase.split())
        held = F.contains(joined, F.lit(f" {phrase} "))
        places.append(F.regexp_count(joined, F.lit(f"(?= {phrase} )")))
        firsts.append(F.when(held, spaces(F.substring(joined, F.lit(1), F.instr(joined, F.lit(f" {phrase} ")) - 1))))
        # of n words there are n + 1 spaces; behind the last place stand those that the reversed text has before it
        behind = spaces(F.substring(backwards, F.lit(1), F.instr(backwards, F.lit(f" {phrase[::-1]} ")) - 1))
        lasts.append(F.when(held, spaces(joined) - 1 - behind - n_words))
        labels.append(F.when(held, F.lit(label)))
    return [sum(places[1:], places[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
            F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base_labels")]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases, labels of both ways, and a score from 0 to 1."""
    spark = docs.sparkSession
    rows = slim(docs, "doc_id", "text")
    templates = _templates(*document_frequency(rows))
    rare = sorted({w for t in templates for w in t["rare"]})
    looked = sorted({w for t in templates for w in t["rare"] | t["key_words"]})
    # a cheap test on the raw text first; it lets through more than is needed, never less
    cue = F.lower("text").rlike(rf"license|cc[^0-9a-z]+by|(?<![0-9a-z])(?:{'|'.join(rare)})(?![0-9a-z])")
    held = cut(rows.where(cue).select("doc_id", text_key().alias("key"), _joined(F.col("text")).alias("joined")))
    base = held.select("doc_id", "key", *_phrase_counts(F.col("joined")))

    # the places of a file's rare license words, and of words of key phrases where it has such
    words = held.select("doc_id", "key", F.split(F.substring("joined", F.lit(2), F.length("joined") - 2), " ").alias("words"))
    places = (
        words.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in rare])))
        .select("doc_id", "key", F.posexplode("words").alias("place", "word")).where(F.col("word").isin(looked)))
    postings = _literal(spark, [(w, t["template"], k, 1 << k) for t in templates for k, w in enumerate(t["words"]) if w in t["rare"] | t["key_words"]],
                        ["word", "template", "at", "bit"], ["string", "int", "int", "long"])
    # the postings are as many as the templates' words: fixed, so broadcast
    hits = places.join(F.broadcast(postings), "word").groupBy("doc_id", "key", "template", (F.col("place") - F.col("at")).alias("offset")).agg(
        F.bit_or("bit").alias("mask"))
    share = F.lit(0.0)
    whole = F.lit(False)
    name = F.lit(None).cast("string")
    for t in templates:
        total = sum(t["idf"][w] for w in t["rare"])
        # a word's first place in the template stands for it
        got = sum((F.when(F.col("mask").bitwiseAND(F.lit(1 << t["words"].index(w))) != 0, t["idf"][w]).otherwise(0.0) for w in sorted(t["rare"])), F.lit(0.0))
        this = F.col("template") == t["template"]
        share = F.when(this, got / total).otherwise(share)
        whole = F.when(this, F.col("mask").bitwiseAND(F.lit(t["key"])) == t["key"]).otherwise(whole)
        name = F.when(this, F.lit(t["label"])).otherwise(name)
    judged = hits.select("doc_id", "key", F.least(share, F.lit(1.0)).alias("share"), (whole & (share >= ENOUGH)).alias("sure"), name.alias("label"))
    method = judged.groupBy("doc_id", "key").agg(
        F.array_distinct(F.array_compact(F.collect_set(F.when(F.col("sure"), F.col("label"))))).alias("found"),
        F.max(F.when(F.col("sure"), F.col("share")).otherwise(F.col("share") / 2)).alias("share"))
    # rows of equal id and text are equal here, so one of them stands for all
    one = base.groupBy("doc_id", "key").agg(*[F.first(c).alias(c) for c in ("n_base", "first_word", "last_word", "base_labels")])
    m = method.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "found", "share")
    both = one.join(m, one["doc_id"].eqNullSafe(m["_id"]) & (one["key"] == m["_key"]), "left").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n_base", "first_word", "last_word", "base_labels",
        F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"))
    every = rows.select("doc_id", text_key().alias("key"), F.coalesce(F.regexp_count("text", F.lit(_WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    comma = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return every.join(both, every["doc_id"].eqNullSafe(both["_id"]) & (every["key"] == both["_key"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        comma(F.col("base_labels")).alias("base_labels"), comma(F.col("labels")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Licence notices by a positional index of rare words.

A template is a word sequence with a label and mandatory key phrases. The index holds, for each template, its
``RARE`` words of highest inverse document frequency in the corpus, with their positions. Each place in a file where such a word
stands is looked up; a posting (template, position) there proposes that the template begins at place - position. Proposals
are intersected by relative position: other rare words of the template must stand at theirs. What is left is verified word by
word at the mandatory key phrases. Places are found for all occurrences, with no bound on their number. Templates are short notices,
passages of the licences' own texts, each of a stretch in which nothing varies, and identifier lines; an identifier is told by how it begins.

The corpus contributes one number per template word (a few hundred words, whatever its size); these alone come to the driver.
Everything is column expressions; a file's work is linear in its words.

Defined results: a null text counts as the empty one, with no word and no place; rows with a null doc_id keep it; repeated rows
are scanned each and count each in the frequencies; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, texts
from .licence_texts import IDENTIFIERS, PASSAGES

RARE = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHIFT = 1 << 40  # a proposal is template * SHIFT + place + BACK, one long
BACK = 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_phrases: tuple[tuple[str, ...], ...]

    @classmethod
    def of(cls, label: str, text: str, *key_phrases: str) -> Template:
        made = cls(label, tuple(text.split()), tuple(tuple(p.split()) for p in key_phrases))
        if not all(made.place(p) is not None for p in made.key_phrases):
            raise ValueError(f"a key phrase of {label} isn't in its text")
        return made

    def place(self, phrase: tuple[str, ...]) -> int | None:
        return next((i for i in range(len(self.words)) if self.words[i:i + len(phrase)] == phrase), None)

    def mandatory(self) -> list[int]:
        return sorted({self.place(p) + k for p in self.key_phrases for k in range(len(p))})


# Fixed values of the contract: phrases and their labels.
PHRASES = [Template.of(label, text, text) for text, label in (
    ("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))]

# The words of well-known public licence notices, and the phrases without which they aren't that licence.
NOTICES = [
    Template.of("mit", "mit license", "mit license"),
    Template.of("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    Template.of("mit", "released under the mit license", "mit license"),
    Template.of("mit", "licensed under the mit license", "mit license"),
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                "associated documentation files the software to deal in the software without restriction",
                "permission is hereby granted free of charge", "deal in the software without restriction"),
    Template.of("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template.of("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
                "that the following conditions are met", "redistribution and use in source and binary forms"),
    Template.of("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template.of("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template.of("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template.of("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template.of("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
                "mozilla public license"),
    Template.of("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template.of("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template.of("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template.of("cc0", "released under cc0 1 0 universal", "cc0 1 0"),
    Template.of("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                "hereby granted", "permission to use copy modify and or distribute this software"),
    Template.of("unlicense", "this is free and unencumbered software released into the public domain",
                "free and unencumbered software"),
]


def plain_words(text: str) -> str:
    """A template's words as ``words_of`` gives those of a file."""
    return re.sub(NOT_WORD, " ", text.lower()).strip()


def passage(label: str, text: str, *key_phrases: str) -> Template:
    """A template of a passage; its first and its last five words are mandatory if no phrases are named."""
    words = plain_words(text)
    return Template.of(label, words, *(key_phrases or (" ".join(words.split()[:5]), " ".join(words.split()[-5:]))))


def identifier(label: str, name: str) -> Template:
    line = plain_words(f"SPDX-License-Identifier: {name}")
    return Template.of(label, line, line)


NOTICES += [passage(*p) for p in PASSAGES] + [identifier(label, name) for name, label in IDENTIFIERS.items()]


def words_of(text: Column) -> Column:
    """Words in lower case. Full lower-casing agrees with that of A to Z on every ASCII word, and keeps word borders."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each word of a given vocabulary stands, and how many documents there are."""
    present = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))
    # the empty string stands for the document itself
    counted = texts(docs).select(F.explode(F.concat(F.array(F.lit("")), present)).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}  # one row per word of the vocabulary at most
    return found, found.pop("", 0)


def rare_positions(template: Template, idf: dict[str, float], rare: int) -> list[int]:
    """Positions of the template's words of highest inverse document frequency; ties go to the earlier one."""
    return sorted(sorted(range(len(template.words)), key=lambda i: (-idf[template.words[i]], i))[:rare])


def places(words: Column, templates: list[Template], rare: list[list[int]]) -> Column:
    """(template, start, share) of every verified place; share is that of the template's words that stand at theirs."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (template, own) in enumerate(zip(templates, rare)):
        for i in own:
            postings.setdefault(template.words[i], []).append((t, i))
    looked_up = F.create_map(*[x for w, found in postings.items() for x in (
        F.lit(w), F.array(*[F.lit(t * SHIFT + BACK - i) for t, i in found]))])
    known = F.array(*[F.struct(
        F.lit(list(t.words)).alias("words"), F.array(*[F.lit(i) for i in own]).alias("rare"),
        F.array(*[F.lit(i) for i in t.mandatory()]).alias("mandatory")) for t, own in zip(templates, rare)])

    def stands(template: Column, start: Column):
        return lambda i: F.coalesce(F.get(words, start + i) == F.get(template["words"], i), F.lit(False))

    def verified(p: Column) -> Column:
        return let(F.get(known, p["template"]), lambda t: let(
            F.size(F.filter(t["rare"], stands(t, p["start"]))), lambda n: (n >= F.least(F.lit(2), F.size(t["rare"])))
            & F.forall(t["mandatory"], stands(t, p["start"]))))

    def scored(p: Column) -> Column:
        agree = let(F.get(known, p["template"]), lambda t: F.size(F.filter(
            F.sequence(F.lit(0), F.size(t["words"]) - 1), stands(t, p["start"]))) / F.size(t["words"]))
        return F.struct(p["template"].alias("template"), p["start"].alias("start"), agree.alias("share"))

    def at(proposals: Column) -> Column:
        cut = F.transform(proposals, lambda p: F.struct(
            F.floor(p / SHIFT).cast("int").alias("template"), (p % SHIFT - BACK).cast("int").alias("start")))
        return F.transform(F.filter(cut, verified), scored)

    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(postings)), i)), lambda i: i.isNotNull())
    return at(F.array_distinct(F.flatten(F.transform(
        hits, lambda i: F.transform(F.element_at(looked_up, F.get(words, i)), lambda p: p + i)))))


def scan(docs: DataFrame, phrases: list[Template] | None = None, notices: list[Template] | None = None,
         rare: int = RARE) -> DataFrame:
    """(doc_id, n_words, phrases, notices): both arrays of (label, start, share), all places.

    A phrase is looked up by its rarest word alone, a notice by ``rare`` words of which two must agree.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    vocabulary = sorted({w for t in (*phrases, *notices) for w in t.words})
    found, documents = document_frequencies(docs, vocabulary)
    idf = {w: math.log((documents + 1) / (found.get(w, 0) + 1)) for w in vocabulary}
    templates = [*phrases, *notices]
    index = [rare_positions(t, idf, 1 if k < len(phrases) else rare) for k, t in enumerate(templates)]
    labels = F.lit([t.label for t in templates])
    own = texts(docs).select("doc_id", words_of(F.col("text")).alias("words"))
    # one pass over the words serves both kinds
    own = own.select("doc_id", F.size("words").cast("long").alias("n_words"), places(F.col("words"), templates, index).alias("all"))

    def of_kind(phrase: bool) -> Column:
        mine = F.filter("all", lambda p: (p["template"] < len(phrases)) if phrase else (p["template"] >= len(phrases)))
        return F.transform(mine, lambda p: F.struct(
            F.get(labels, p["template"]).alias("label"), p["start"].cast("long").alias("start"), p["share"].alias("share")))

    return own.select("doc_id", "n_words", of_kind(True).alias("phrases"), of_kind(False).alias("notices"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place of the fixed phrases, labels and a score: the largest share of a verified place."""
    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform("phrases", lambda p: p["start"])
    everything = F.concat("phrases", "notices")
    return scanned.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(F.col("phrases")).alias("base_labels"), joined(everything).alias("labels"),
        F.coalesce(F.array_max(F.transform(everything, lambda p: p["share"])), F.lit(0.0)).alias("score"))

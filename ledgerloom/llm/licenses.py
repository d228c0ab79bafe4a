"""Licence scan by a positional index of rare words, with DataFrame functions only.

One pass over the texts writes, for each document, its number of words and the places
of all words that some template has. From that table come the document frequencies of
those words over the whole corpus, and so each template's rarest mandatory word. Only
places of such words are looked up: a place at ``p`` of the word that a template has at
``o`` proposes the template at ``p - o``; the other places vote for it where their
relative positions agree. A proposal stands if every word of the mandatory key phrase
agrees and the share of agreeing words reaches the template's least share.

The rare word is taken from the key phrase, which a match must hold whole, so frequencies
decide what is looked up and never what is found. All words of a phrase are in the
index; those of one match lie next to each other in a document's sorted places, so a
proposal is checked against a slice as long as the template.

A document is judged by its own row: no shuffle but that of at most one count per
template word and task. Defined results: a null or empty text has no words, no places,
score 0 and empty labels; rows are judged one by one, whatever their ids. Input columns
are kept, except that those named like the operator's are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .names import plain_names
from .scratch import Scratch


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # the mandatory phrase: from, to
    base: bool = False
    least: float = 1.0


def _phrase(label: str, text: str, base: bool = False) -> Template:
    w = tuple(text.split())
    return Template(label, w, (0, len(w)), base)


def _notice(label: str, before: str, key: str, after: str, least: float = 0.8) -> Template:
    a, k, b = before.split(), key.split(), after.split()
    return Template(label, (*a, *k, *b), (len(a), len(a) + len(k)), False, least)


# The four agreed phrases, then names and notices of public licences.
TEMPLATES = (
    _phrase("gpl", "gnu general public license", base=True),
    _phrase("apache", "apache license", base=True),
    _phrase("cc-by", "cc by", base=True),
    _phrase("mit", "mit license", base=True),
    _phrase("lgpl", "gnu lesser general public license"),
    _phrase("agpl", "gnu affero general public license"),
    _phrase("mpl", "mozilla public license"),
    _phrase("cc-by", "creative commons attribution"),
    _phrase("bsl", "boost software license"),
    _notice("gpl", "this program is free software you can", "redistribute it and or modify it", "under the terms of the gnu general public license as published by the free software foundation"),
    _notice("mit", "permission is hereby granted", "free of charge to any person obtaining a copy", "of this software and associated documentation files"),
    _notice("bsd", "", "redistribution and use in source and binary forms", "with or without modification are permitted provided that the following conditions are met"),
    _notice("isc", "permission to use copy modify and or distribute this software", "for any purpose with or without fee is hereby granted", ""),
    _notice("unlicense", "this is free and unencumbered software", "released into the public domain", ""),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _array(items: list[str]) -> str:
    return f"array({', '.join(items)})"


def _words(t: Template) -> str:
    return _array([f"'{w}'" for w in t.words])


@plain_names("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
def scan_licenses(docs: DataFrame, *, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` without its text, with n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches`` holds (label, start, share, base) for every match; ``score`` is the best share.
    """
    spark = docs.sparkSession
    own = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches", "__lic_hits")
    kept = [c for c in docs.columns if c not in own and c != text_col]
    vocabulary = sorted({w for t in templates for w in t.words})
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    listed = docs.select(*kept, F.array_remove(F.split(text, SEPARATORS, -1), "").alias("__lic_hits"))
    quoted = ", ".join(f"'{w}'" for w in vocabulary)
    placed = listed.select(
        *kept,
        F.size("__lic_hits").cast("long").alias("n_words"),
        F.expr(f"filter(transform(__lic_hits, (w, i) -> CASE WHEN w IN ({quoted}) THEN named_struct('p', i, 'w', w) END), h -> h IS NOT NULL)").alias("__lic_hits"),
    )
    index = Scratch(spark, "licenses").table(placed, "places")
    seen = index.select(F.explode(F.array_distinct(F.col("__lic_hits.w"))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in seen.collect()}  # a row for each template word at most
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        at = min(range(*t.key), key=lambda i: (df.get(t.words[i], 0), t.words[i]))
        postings.setdefault(t.words[at], []).append((k, at))
    rare = ", ".join(f"'{w}'" for w in postings)
    found = []  # one expression per rare word: its places, each against the templates that have it
    for w, where in postings.items():
        for k, at in where:
            t = templates[k]
            n, (a, b) = len(t.words), t.key
            inside = f"filter(slice(__lic_hits, greatest(1, r.j + 1 - {at}), {2 * n}), g -> g.p >= r.p - {at} AND g.p < r.p - {at} + {n} AND g.w = get({_words(t)}, g.p - (r.p - {at})))"
            found.append(
                f"transform(filter(__lic_rare, r -> r.w = '{w}'), r -> named_struct('label', '{t.label}', 'base', {str(t.base).lower()}, 'start', bigint(r.p - {at}), "
                f"'n', {n}, 'least', double({t.least}), 'hit', transform({inside}, g -> g.p - (r.p - {at})), 'a', {a}, 'b', {b}))"
            )
    index = index.withColumn("__lic_rare", F.expr(f"filter(transform(__lic_hits, (h, j) -> CASE WHEN h.w IN ({rare}) THEN named_struct('p', h.p, 'w', h.w, 'j', j) END), h -> h IS NOT NULL)"))
    proposals = f"flatten({_array(found)})"
    agreed = f"filter({proposals}, m -> size(filter(m.hit, x -> x >= m.a AND x < m.b)) = m.b - m.a AND size(m.hit) >= m.least * m.n)"
    matches = f"transform({agreed}, m -> named_struct('label', m.label, 'start', m.start, 'share', size(m.hit) / double(m.n), 'base', m.base))"
    # Most documents have no rare word; those get the empty answer without any look-up.
    kind = "array<struct<label:string,start:bigint,share:double,base:boolean>>"
    out = index.withColumn("matches", F.expr(f"CASE WHEN size(__lic_rare) = 0 THEN cast(array() AS {kind}) ELSE {matches} END"))
    base = "filter(matches, m -> m.base)"
    return out.select(
        *kept,
        "n_words",
        F.expr(f"bigint(size({base}))").alias("n_base"),
        F.expr(f"array_min(transform({base}, m -> m.start))").alias("first_word"),
        F.expr(f"array_max(transform({base}, m -> m.start))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({base}, m -> m.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(matches, m -> m.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(matches, m -> m.share)), double(0))").alias("score"),
        "matches",
    )

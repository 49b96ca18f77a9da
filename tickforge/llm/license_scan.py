"""License phrases and license templates in whole texts, in DataFrame operations only.

Templates are found by an exact set-similarity join of text blocks with templates on containment: of a template's distinct
words at least PERCENT per cent stand in the block. Blocks are the lines of at most SPAN words and, as license texts are wrapped or stand in long lines, overlapping
windows of SPAN words of the whole text, such that any REACH words in a row stand in one. Words are put in the order of their document frequency; a block that meets
the threshold has one of the template's first |T| - need + 1 words (prefix filter), at least `need` template words in all
(length filter), and enough words left beyond a common one on either side (positional filter). A document is looked at
block by block only if its words as a whole meet some template's threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import cut, prepare

PERCENT = 90

# The base phrases, and opening sentences of public license texts and notices.
BASE = {"apache": "apache license", "gpl": "general public license", "mit": "mit license"}
TEMPLATES = [
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("artistic", "this is free software you can redistribute it under the terms of the artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]
#: The longest template, and a few words more for comment marks that are words.
REACH = max(len(x.split()) for _, x in TEMPLATES) + 5
#: From one window of words to the next, and the words of a window.
STEP = REACH // 2
SPAN = REACH + STEP - 1
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _phrase(words: str) -> str:
    """A pattern for these words standing one after the other, A-Z as a-z."""
    return rf"(?i)(?<!{_WORD})" + rf"{_GAP}+".join(map(re.escape, words.split())) + rf"(?!{_WORD})"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _words(text: Column) -> Column:
    """Words with A-Z as a-z. The Kelvin sign alone of all other characters would become one of a-z, so it is put out of the way."""
    return F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00b0"))), f"{_GAP}+")


def base_phrases(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word and base_labels; `body` is the text, null as empty."""
    body = F.col("body")
    maybe = F.col("maybe")
    out = docs.withColumn("body", F.coalesce("text", F.lit(""))).withColumn("maybe", body.rlike("(?i)license"))
    out = out.withColumn("n_words", _count(body, f"{_WORD}+"))
    for label, words in BASE.items():
        out = out.withColumn(f"n_{label}", F.when(maybe, _count(body, _phrase(words))).otherwise(0))
    out = out.withColumn("n_base", sum((F.col(f"n_{x}") for x in BASE), F.lit(0).cast("long")))
    either = "(?:" + "|".join(map(_phrase, BASE.values())) + ")"
    before_first = F.split(body, either, 2)[0]
    before_last = F.regexp_extract(body, f"(?s)^(.*){either}", 1)
    out = out.withColumn("first_word", F.when(F.col("n_base") > 0, _count(before_first, f"{_WORD}+")))
    out = out.withColumn("last_word", F.when(F.col("n_base") > 0, _count(before_last, f"{_WORD}+")))
    labels = F.concat_ws(",", *(F.when(F.col(f"n_{x}") > 0, F.lit(x)) for x in BASE))
    return out.withColumn("base_labels", labels).drop("maybe", *(f"n_{x}" for x in BASE))


def template_matches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """tag, label, containment: the best block of each document tag (docs: tag, text) for each label that some block meets.

    One pass finds the template words of every document, to count them and to keep the texts that may have such a block.
    """
    spark = docs.sparkSession
    sets = [(label, frozenset(text.split())) for label, text in TEMPLATES]
    vocabulary = sorted(set().union(*(x for _, x in sets)))
    array = lambda words: F.array(*map(F.lit, words))
    least = [(sorted(x), -(-percent * len(x) // 100)) for _, x in sets]
    enough = F.lit(False)
    for words, need in least:
        enough = enough | (F.size(F.array_intersect("known", array(words))) >= need)
    # explode() of a single element keeps the optimiser from repeating the expression for every use
    known = docs.select("tag", "text", F.explode(F.array(F.array_intersect(_words(F.col("text")), array(vocabulary)))).alias("known"))
    own = cut(known.select("tag", "known", F.when(enough, F.col("text")).alias("text")))
    counts = {r["w"]: r["n"] for r in own.select(F.explode("known").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each template word
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows = []
    for k, (label, words) in enumerate(sets):
        need = -(-percent * len(words) // 100)
        order = sorted(words, key=rank.get)
        rows += [(k, label, w, i, len(words), need, order) for i, w in enumerate(order[: len(words) - need + 1])]
    prefixes = spark.createDataFrame(rows, "template int, label string, word string, i int, size int, need int, words array<string>")
    texts = own.where("text is not null")
    lines = texts.select("tag", F.explode(F.split("text", "\n")).alias("body"))
    lines = lines.select("tag", F.explode(F.array(F.array_remove(_words(F.col("body")), ""))).alias("body")).where(F.size("body") <= SPAN)
    spans = texts.select("tag", F.explode(F.array(_words(F.col("text")))).alias("all"))
    spans = spans.select("tag", "all", F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(STEP))).alias("at"))
    spans = spans.select("tag", F.slice("all", F.col("at"), F.lit(SPAN)).alias("body"))
    ranked = lines.unionByName(spans).select("tag", F.explode(F.array(F.array_intersect(array(sorted(vocabulary, key=rank.get)), F.col("body")))).alias("known"))
    placed = ranked.select("*", F.posexplode("known").alias("j", "word"))
    met = placed.join(F.broadcast(prefixes), "word").where(F.size("known") >= F.col("need"))
    left = F.least("i", "j") + F.least(F.col("size") - F.col("i"), F.size("known") - F.col("j"))
    share = F.size(F.array_intersect("known", "words"))
    found = met.where(left >= F.col("need")).withColumn("share", share).where("share >= need")
    return found.groupBy("tag", "label").agg(F.max(F.col("share") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs.

    score is 1 where a base phrase stands, else the best containment of a template that is met, else 0. Null text counts
    as empty: no words, no labels. Repeated rows and null ids give a row each; other columns don't matter.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("tag", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text").cast("binary")))
    labels = template_matches(rows.where("text is not null").select("tag", "text"), percent)
    per = labels.groupBy("tag").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base_phrases(rows).drop("text", "body").join(per, "tag", "left")
    based = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    every = F.array_sort(F.array_union(based, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", F.concat_ws(",", every).alias("labels"), score.alias("score"))


def oracle() -> str:
    """The same in DuckDB SQL, by comparing every block, short line or window of words, with every template."""
    words = "regexp_extract_all(translate({0}, '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (_UPPER, _LOWER)
    at = lambda phrase: "list_filter(range(1, len(w) + 1), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + ")"
    values = ", ".join(f"('{label}', {sorted(set(text.split()))!r})" for label, text in TEMPLATES)
    spots = ", ".join(f"{at(p)} as {label}" for label, p in BASE.items())
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, {words.format('t')} as w from d),
b as (select r, doc_id, t, len(w) as n_words, {spots} from w),
p as (select *, list_concat(list_concat(apache, gpl), mit) as spots from b),
templates(label, words) as (values {values}),
split as (select r, regexp_split_to_array(translate(t, '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from d),
blocks as (
  select r, w from (select r, {words.format('x')} as w from (select r, unnest(string_split(t, chr(10))) as x from d)) where len(w) <= {SPAN}
  union all select r, w[i : i + {SPAN - 1}] from (select r, w, unnest(range(1, len(w) + 1, {STEP})) as i from split)),
hits as (select r, label, max(len(list_intersect(list_distinct(w), words)) / len(words)) as c from blocks, templates
  where len(list_intersect(list_distinct(w), words)) >= ceil({PERCENT} * len(words) / 100.0) group by all),
m as (select r, list(distinct label) as more, max(c) as best from hits group by r)
select doc_id, n_words::bigint as n_words, len(spots)::bigint as n_base, list_min(spots)::bigint - 1 as first_word, list_max(spots)::bigint - 1 as last_word,
  concat_ws(',', case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end) as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(more, []::varchar[]), list_filter([case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end], lambda x: x is not null)))), ','), '') as labels,
  case when len(spots) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from p left join m using (r)
"""

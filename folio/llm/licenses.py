"""License scans by diagonal voting, in DataFrame code alone.

Each window of GRAM words of a text is hashed and joined to the places where templates have the same
words. A hit votes for a diagonal: its place in the text less its place in the template. On one diagonal
the text runs along with the template; words left out or put in move it to a neighbouring one, so that
neighbouring diagonals that go on in text and template are merged to a span. Spans are then verified
by the share of the template's words that stand there in order, and words that tell templates apart
must be among them.

Texts are known by their digest: copies of a text vote once for all, as far as a task or the sum over
tasks can see, and what is found is joined back to rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import passing_tables, written

#: Words of a hashed window, how far diagonals of a span may lie apart, and the share of a template (and of the span) that counts.
GRAM, DRIFT, LEAST_SHARE = 3, 5, 0.8
#: Up to so many places of templates are sent to all executors (some 20 MB); more are joined by a shuffle.
BROADCAST_PLACES = 100_000

#: Words of a text with A-Z in lower case, and the same before that.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The one character beyond ASCII whose lower case is an ASCII letter, and one that stands in for it.
KELVIN, NOT_KELVIN = "K", "ĸ"

#: Phrases whose places are counted.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Words of public license notices. Those in braces must be there.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "licensed under the terms of the {mit} license"),
    ("apache-2", "licensed under the apache license version {2} 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the terms of the {apache} license version {2} 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2", "licensed under the gnu {general} public license version {2}"),
    ("gpl-3", "licensed under the gnu {general} public license version {3}"),
    ("lgpl-2", "licensed under the gnu {lesser} general public license version {2}"),
    ("lgpl-3", "licensed under the gnu {lesser} general public license version {3}"),
    ("agpl-3", "licensed under the gnu {affero} general public license version {3}"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v {2} 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license {2} 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "this work is licensed under a creative commons {attribution} {4} 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution {sharealike} 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution {noncommercial} 4 0 international license"),
]

_TEMPLATE = "template int, label string, base boolean, text string, must array<int>"


def templates(spark: SparkSession, phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(template, label, base, text, must): the phrases (base) and notices with numbers; must: the places of words in braces."""
    rows = []
    for base, known in ((True, PHRASES if phrases is None else phrases), (False, NOTICES if notices is None else notices)):
        for label, text in known:
            marked = re.findall(r"\{?[0-9a-z\x80-\U0010ffff]+", text.lower())
            if len(marked) < GRAM:
                raise ValueError(f"a template needs {GRAM} words: {text!r}")
            rows.append((len(rows), label, base, text, [n for n, w in enumerate(marked) if w[0] == "{"]))
    return spark.createDataFrame(rows, _TEMPLATE)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit(KELVIN), F.lit(NOT_KELVIN))), F.lit(WORD), F.lit(0))


def _grams(df: DataFrame, place: str) -> DataFrame:
    """df (..., words) as rows (..., place, w0, w1, w2) of its windows."""
    names = [f"w{n}" for n in range(GRAM)]
    moved = F.arrays_zip(*[(F.col("words") if not n else F.when(F.size("words") > n, F.slice("words", F.lit(n + 1), F.size("words")))).alias(w) for n, w in enumerate(names)])
    rest = [c for c in df.columns if c != "words"]
    return df.where(F.size("words") >= GRAM).select(*rest, F.posexplode(moved).alias(place, "g")).select(*rest, place, *[f"g.{w}" for w in names]).where(F.col(names[-1]).isNotNull())


def _places(known: DataFrame) -> DataFrame:
    """(h, template, label, base, length, must, at, t0, t1, t2): every window of every template, sent to all executors if they are few."""
    rows = known.withColumn("words", _words(F.col("text"))).withColumn("length", F.size("words")).drop("text")
    rows = _grams(rows, "at").withColumnsRenamed({f"w{n}": f"t{n}" for n in range(GRAM)})
    rows = rows.withColumn("h", F.xxhash64(*[f"t{n}" for n in range(GRAM)]))
    return F.broadcast(rows) if rows.count() <= BROADCAST_PLACES else rows


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def diagonals(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, template, label, base, length, must, diagonal, ats): the places of the template that vote for each diagonal of a text, ascending."""
    grams = _grams(docs.where("text is not null").select(_digest(F.col("text")).alias("digest"), _words(F.col("text")).alias("words")), "place")
    hits = grams.withColumn("h", F.xxhash64(*[f"w{n}" for n in range(GRAM)])).join(_places(known), "h")
    for n in range(GRAM):
        hits = hits.where(F.col(f"w{n}") == F.col(f"t{n}"))
    of_template = ["template", "label", "base", "length", "must"]
    return hits.groupBy("digest", *of_template, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.sort_array(F.collect_set("at")).alias("ats"))


def _covered(ats: Column) -> Column:
    """The template's words under windows at these places."""
    return F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + (GRAM - 1)))))


def base_places(found: DataFrame) -> DataFrame:
    """(digest, label, first_word, end_word, covered, share, base): where all windows of a phrase vote for one diagonal, its words stand in a row."""
    whole = found.where(F.col("base") & (F.size("ats") == F.col("length") - (GRAM - 1)))
    return whole.select("digest", "label", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("length")).alias("end_word"), F.col("length").alias("covered"), F.lit(1.0).alias("share"), "base")


def merged_spans(found: DataFrame) -> DataFrame:
    """Spans of notices in the columns of base_places(): neighbouring diagonals that go on in text and template, verified.

    A span counts if LEAST_SHARE of the template's words, and of its own, are covered, and all that the
    template must have. Of spans that overlap, one with fewer covered words does not count.
    """
    rows = found.where(~F.col("base")).withColumn("start", F.col("diagonal") + F.col("ats")[0])
    order = Window.partitionBy("digest", "template").orderBy("start", "diagonal")
    before = F.lag(F.struct("diagonal", F.col("ats")[0].alias("at"))).over(order)
    rows = rows.withColumn("b", before).withColumn("new", F.coalesce((F.abs(F.col("diagonal") - F.col("b.diagonal")) > DRIFT) | (F.col("ats")[0] <= F.col("b.at")), F.lit(True)))
    rows = rows.withColumn("span", F.sum(F.col("new").cast("int")).over(order))
    ends = F.col("diagonal") + F.element_at("ats", -1) + GRAM
    spans = rows.groupBy("digest", "template", "label", "length", "must", "span").agg(F.min("start").alias("first_word"), F.max(ends).alias("end_word"), F.flatten(F.collect_list("ats")).alias("ats"))
    spans = spans.withColumn("words", _covered(F.col("ats"))).withColumn("covered", F.size("words"))
    share = F.col("covered") / F.greatest(F.col("length"), F.col("end_word") - F.col("first_word"))
    good = spans.withColumn("share", share).where((F.col("share") >= LEAST_SHARE) & (F.size(F.array_except("must", "words")) == 0))
    longest = 1 + int(1 / LEAST_SHARE * (found.agg(F.max("length")).first()[0] or 0))
    near = Window.partitionBy("digest").orderBy("first_word").rangeBetween(-longest, longest)
    others = F.collect_list(F.struct("first_word", "end_word", "covered")).over(near)
    beaten = F.exists("others", lambda o: (o["covered"] > F.col("covered")) & (o["first_word"] < F.col("end_word")) & (F.col("first_word") < o["end_word"]))
    return good.withColumn("others", others).where(~beaten).select("digest", "label", "first_word", "end_word", "covered", "share", F.lit(False).alias("base"))


def spans(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(digest, label, first_word, end_word, covered, share, base): places of phrases and verified spans of notices, once for each different text.

    digest: the text's MD5. Words are counted from 0, end_word is exclusive.
    """
    with passing_tables(docs.sparkSession) as keep:
        found = written(diagonals(docs, templates(docs.sparkSession) if known is None else known), "diagonals")  # texts are read once for all that follows
        return keep(base_places(found).unionByName(merged_spans(found)), "spans")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. n_base:
    places where a phrase's words stand in a row; first_word and last_word: the least and greatest start of
    these, null if there is none. labels: those of phrases and of notices; score: the greatest share of a
    template that was found (1 for phrases, 0 for nothing). Null texts are empty, rows that repeat an id or
    a text get a row each, null ids too; an empty table gives an empty result; other columns are left out.
    A template with letters beyond ASCII is met in either case of these.
    """
    found = spans(docs, known)
    base = F.when(F.col("base"), F.col("first_word"))
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    by_text = found.groupBy("digest").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"), labels(F.col("label")).alias("labels"), F.max("share").alias("score"),
    )
    rows = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"), _digest(F.col("text")).alias("digest"))
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    joined = rows.join(by_text, "digest", "left")
    return joined.select("doc_id", "n_words", *[F.coalesce(c, empty[c]).alias(c) if c in empty else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])

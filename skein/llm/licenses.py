"""Licence scans (operator 6): a positional rare-token index.  DataFrame functions only.

Every template (a notice or the opening of a licence text) is a sequence of words.  The index holds the place of
each of its words but for function words.  A file looks each template up by those of its words that the file holds and
that are of highest IDF over all files, whatever other templates the file holds too.  A posting and an occurrence in the
file agree on a relative position; a template whose words meet at one relative position often enough, and whose mandatory
phrases all stand in the file, gives its label.
The base is plain: each place where the words of one of three phrases stand consecutively.

Defined cases: a null or empty text has no words, labels or places and score 0; repeated rows are scanned alike and
each on its own; other columns are ignored; an empty table gives an empty result; ties in IDF go to the alphabetically
first word; a very long text is read whole, and only the places of template words are kept of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut_lineage

#: What separates words; capital letters are folded first.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The one character beyond ASCII that folds to an ASCII letter alone (the Kelvin sign), and a letter that doesn't.
KELVIN, OTHER = "\u212a", "\u0138"

#: Phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed values: (label, words of the template, phrases that must stand in a file).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("gpl-2.0", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3", ["gnu general public license", "version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
]
#: Function words, which no posting is kept of.
COMMON = "the of and or to in a is at as by it with for this that you any are under on"
#: So many of a template's words in a file, the rarest, are looked up.
RAREST = 8
#: A template is found where this share of its rarest indexed words meets at one relative position.
SHARE = 0.6


#: Fewer words than the shortest template needs.
LEAST_WORDS = min(math.ceil(SHARE * min(RAREST, len(set(text.split()) - set(COMMON.split())))) for _, text, _ in TEMPLATES)


def _index(spark) -> DataFrame:
    """(template, label, word, place, top): the postings, and how many of its words could be met at most."""
    common = set(COMMON.split())
    rows = []
    for k, (label, text, _) in enumerate(TEMPLATES):
        words = text.split()
        kept = [(w, i) for i, w in enumerate(words) if w not in common]
        rows += [(k, label, w, i, min(RAREST, len({x for x, _ in kept}))) for w, i in kept]
    return spark.createDataFrame(rows, "template int, label string, word string, place int, top int")


def _known() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} - set(COMMON.split()))


def _choice(k: int) -> Column:
    """(template, words, verified): the words by which a file looks a template up, and whether its mandatory phrases stand
    there; null if the file holds too few of its words."""
    _, text, phrases = TEMPLATES[k]
    own = sorted(set(text.split()) - set(COMMON.split()))
    words = F.slice(F.array_intersect("rarest_first", F.array_intersect(F.array(*map(F.lit, own)), "held")), 1, RAREST)
    least = math.ceil(SHARE * min(RAREST, len(own)))
    named = F.size(F.array_except(F.array(*map(F.lit, phrases)), "phrases")) == 0
    return F.when(F.size(words) >= least, F.struct(F.lit(k).alias("template"), words.alias("words"), named.alias("verified")))


def _holds(phrase: str) -> Column:
    """Whether the words of a phrase stand consecutively in ``joined``, the words between single spaces."""
    return F.contains("joined", F.lit(f" {phrase} "))


def _places(phrase: str) -> Column:
    """Where the words of a phrase stand consecutively, as word numbers from 0."""
    parts = phrase.split()

    def starts(i: Column) -> Column:
        same = F.get("words", i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get("words", i + k) == part)
        return F.coalesce(same, F.lit(False))

    everywhere = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(_holds(phrase), F.filter(everywhere, starts)).otherwise(F.array().cast("array<int>"))


def fold_capitals(text: Column) -> Column:
    """The text with A-Z folded.  Letters beyond ASCII are folded as well, which no ASCII word can tell: none of them
    becomes a word in ASCII but for the Kelvin sign, which is replaced before."""
    return F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER)))


def read(docs: DataFrame) -> DataFrame:
    """One narrow row for each file: doc_id, n_words, base places and labels, the template words that it holds, the
    mandatory phrases that stand in it and, where a template could be looked up, the places of the template words.  The
    texts are read once; the index is made from these rows."""
    known = _known()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split(fold_capitals(F.col("text")), SEPARATORS), ""))
    rows = rows.withColumn("held", F.array_intersect("words", F.array(*map(F.lit, known))))
    rows = rows.withColumn("joined", F.when(F.size("held") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise(""))
    places = {label: _places(phrase) for phrase, label in PHRASES.items()}
    rows = rows.withColumns({f"at_{label}": p for label, p in places.items()})
    every = F.concat(*[F.col(f"at_{label}") for label in places])
    named = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in places]))
    phrases = sorted({p for _, _, ps in TEMPLATES for p in ps})
    stand = F.when(F.size("held") > 0, F.array_compact(F.array(*[F.when(_holds(p), F.lit(p)) for p in phrases]))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"every": every, "base": F.sort_array(named), "phrases": stand})
    found = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(*known))
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        "base", "held", "phrases", F.when(F.size("held") >= LEAST_WORDS, found).alias("found"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    spark = docs.sparkSession
    # A row's own number tells rows apart that share id and text.
    rows = cut_lineage(read(docs).withColumn("key", F.monotonically_increasing_id()))

    # The index: postings and IDF have a row for each word of the templates, whatever the number of files.
    frequency = rows.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = frequency.filter("word = ''").select(F.col("df").alias("files"))
    idf = frequency.filter("word <> ''").join(F.broadcast(total)).select("word", F.log(F.col("files") / F.col("df") + 1).alias("idf"))
    postings = F.broadcast(_index(spark).join(F.broadcast(idf), "word"))
    by_idf = F.broadcast(idf.groupBy().agg(F.expr("transform(sort_array(collect_list(struct(-idf AS idf, word))), x -> x.word)").alias("rarest_first")))

    # A row for each template that a file looks up; the files' words are then read against its words only.
    choices = F.array_compact(F.array(*[_choice(k) for k in range(len(TEMPLATES))]))
    hits = rows.filter(F.size("held") >= LEAST_WORDS).join(by_idf).select("key", "found", F.explode(choices).alias("choice"))
    looked_up = F.filter("found", lambda x: F.array_contains("choice.words", x["word"]))
    met = hits.select("key", "choice.template", "choice.verified", F.explode(looked_up).alias("x")).select("key", "template", "verified", "x.word", "x.at").join(postings, ["template", "word"])
    lined = met.groupBy("key", "template", "label", "top", "verified", (F.col("at") - F.col("place")).alias("shift")).agg(F.count_distinct("word").alias("n"))
    sure = lined.filter((F.col("n") >= F.ceil(SHARE * F.col("top"))) & F.col("verified"))
    more = sure.groupBy("key").agg(F.collect_set("label").alias("more"), F.max(F.least(F.lit(1.0), F.col("n") / F.col("top"))).alias("score"))

    out = rows.select("key", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(more, "key", "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

"""License scan with a positional index of rare tokens.

Licence templates are indexed by their words: a posting is (template, position).
Each template, a whole licence text or a notice, is filed under the word of its
key phrases with the highest inverse document frequency in the corpus; every place of such a word in a file
makes the template a candidate at that alignment, and since key phrases are
mandatory no other alignment can hold it.  All key phrases are then verified
word by word there.  Everything is DataFrame and SQL functions.  Only words of the
templates' vocabulary (a few hundred) leave the scan of a text, so what is shuffled is small beside it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, written

#: Everything that parts words, as a class: words are runs of 0-9, a-z and all that is not ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases whose every place counts, and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Share of a template's idf that must meet at one alignment.
MATCHED = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of the text that must stand at their places in it.
    key_phrases: tuple[str, ...]


#: Public licence texts, their notices and short references (fixed values).
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD_3_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL_3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
GPL_2_NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""
AGPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
BOOST_NOTICE = """Distributed under the Boost Software License, Version 1.0."""
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", APACHE_NOTICE, ("apache license version 2 0", "you may obtain a copy of the license")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", MIT_TEXT, ("permission is hereby granted free of charge", "associated documentation files")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3.0", GPL_3_NOTICE, ("gnu general public license", "either version 3")),
    Template("gpl-2.0", GPL_2_NOTICE, ("gnu general public license", "either version 2")),
    Template("agpl-3.0", AGPL_NOTICE, ("gnu affero general public license", "either version 3")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-3-clause", BSD_3_TEXT, ("redistribution and use in source and binary forms", "neither the name of", "endorse or promote products")),
    Template("isc", ISC_TEXT, ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mpl-2.0", MPL_NOTICE, ("mozilla public license v 2 0", "a copy of the mpl")),
    Template("zlib", ZLIB_TEXT, ("in no event will the authors be held liable",)),
    Template("unlicense", UNLICENSE_TEXT, ("free and unencumbered software released into the public domain",)),
    Template("bsl-1.0", BOOST_NOTICE, ("boost software license version 1 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def word_array(column="text"):
    """A text's words as an array; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(column), F.lit(""))), BREAKS), lambda w: w != "")


def _starts(words: list[str], phrase: list[str]) -> list[int]:
    return [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]


def postings(spark, templates=TEMPLATES) -> DataFrame:
    """template, label, word, pos, phrase (number of the key phrase that needs it there, or -1), n_words, n_key (words of key phrases).

    As many rows as the templates have words.
    """
    rows = []
    for t, template in enumerate(templates):
        words = words_of(template.text)
        key: dict[int, int] = {}
        for p, phrase in enumerate(template.key_phrases):
            starts = _starts(words, words_of(phrase))
            if not starts:
                raise ValueError(f"{phrase!r} is not in its template")
            key.update({starts[0] + k: p for k in range(len(words_of(phrase)))})
        rows += [(t, template.label, w, k, key.get(k, -1), len(words), len(key)) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "template int, label string, word string, tpos int, phrase int, n_template int, n_key int")


def scan(docs: DataFrame, templates=TEMPLATES, matched: float = MATCHED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places of every row of docs (doc_id, text).

    Base: every place where the words of a phrase stand one after another; labels of the base stay whatever
    the templates say.  score: the largest share of a template's idf that met at one alignment with all key
    phrases, 1 if a base phrase stands there and no template was looked up better, else 0.  places: label,
    first word and score of each alignment.  Null and empty texts have no words.  A doc_id that repeats is
    judged row by row.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in words_of(t.text)} | {w for p in BASE for w in words_of(p)})
    low = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", word_array().alias("words"), low.alias("low"))
    # a word array is walked only where all words of a base phrase, or of a template's key phrases, occur as letters at all
    may = F.lit(False)
    for need in sorted({tuple(words_of(p)) for p in BASE} | {tuple(w for k in t.key_phrases for w in words_of(k)) for t in templates}):
        every = F.lit(True)
        for w in sorted(set(need), key=len, reverse=True):
            every = every & F.contains("low", F.lit(w))
        may = may | every
    places = F.filter(F.transform("words", lambda w, k: F.struct(w.alias("word"), k.alias("pos"))), lambda x: x["word"].isin(vocabulary))
    known = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))  # distinct, of every row
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), known.alias("known"), F.when(may, places).alias("places"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "places")
    found = rows.filter("size(places) > 0").select("row", F.explode("places").alias("p")).select("row", "p.word", "p.pos")

    # base phrases: a phrase of n words stands at s when n postings meet at pos - k = s
    base = spark.createDataFrame([(p, label, w, k, len(words_of(p))) for p, label in BASE.items() for k, w in enumerate(words_of(p))], "base string, base_label string, word string, k int, n int")
    stands = found.join(F.broadcast(base), "word").groupBy("row", "base", "base_label", "n", (F.col("pos") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("met")).filter("met = n")
    based = stands.groupBy("row").agg(F.count(F.lit(1)).alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"), F.collect_set("base_label").alias("base_set"))

    # idf over all documents, walked or not; a row a word of the vocabulary
    total = rows.count()
    idf = rows.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(float(total)) + 1) / (F.col("df") + 1)) + 1).select("word", "idf")
    idf = written(idf, "idf")
    index = postings(spark, templates).join(F.broadcast(idf), "word", "left").fillna({"idf": 1.0})
    whole = index.groupBy("template").agg(F.sum("idf").alias("whole"))
    index = written(index.join(whole, "template"), "index")  # as many rows as the templates have words

    # each template under the rarest word of its key phrases, at one place of it: a row a template
    filed = index.filter("phrase >= 0").groupBy("template").agg(F.max(F.struct("idf", "word", "tpos")).alias("f")).select("template", "f.word", "f.tpos")
    candidates = found.join(F.broadcast(filed), "word").select("row", "template", (F.col("pos") - F.col("tpos")).alias("start"))
    # all postings of a candidate's template against the file's words at that alignment
    met = found.join(F.broadcast(index), "word").withColumn("start", F.col("pos") - F.col("tpos")).join(candidates, ["row", "template", "start"], "left_semi")
    met = met.groupBy("row", "template", "label", "start", "whole", "n_key").agg(F.sum("idf").alias("got"), F.sum((F.col("phrase") >= 0).cast("int")).alias("key_met"))
    sure = met.filter((F.col("key_met") == F.col("n_key")) & (F.col("got") >= matched * F.col("whole")) & (F.col("start") >= 0))
    sure = sure.select("row", F.struct((F.col("got") / F.col("whole")).alias("score"), "label", "start").alias("place"))
    labelled = sure.groupBy("row").agg(F.max("place.score").alias("best"), F.collect_set("place.label").alias("more"), F.sort_array(F.collect_list("place"), asc=False).alias("license_places"))

    out = rows.select("row", "doc_id", "n_words").join(based, "row", "left").join(labelled, "row", "left")
    none = F.array().cast("array<string>")
    score = F.least(F.lit(1.0), F.coalesce("best", F.when(F.col("n_base") > 0, F.lit(1.0)), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base_set", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce("base_set", none), F.coalesce("more", none)))), ",").alias("labels"),
        score.alias("score"), "license_places",
    )

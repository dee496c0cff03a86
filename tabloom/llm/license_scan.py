"""Licence scanning with DataFrame functions and Spark's linear models.

Candidates are the stretches of a paragraph's joined lines whose word pairs stand in the templates, wherever in a line
they begin and end, and windows of words around each licence cue.  They become sparse counts of word 1-, 2- and
3-grams; a multinomial logistic regression, fitted on fragments of licence notices and of ordinary sentences, names a
family.  A threshold calibrated on fragments that a first fit does not see turns unsure predictions into ``unknown``,
and a prediction is confirmed only if enough of the candidate's word pairs stand in the family's own templates.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import saved

#: Fixed licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction, including without limitation the rights"
        " to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is"
        " distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL license, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or any later"
        " version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation",
        "Released under the LGPL license.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the AGPL license.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution licence.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution-NonCommercial licence.",
    ),
    "public-domain": (
        "This work is in the public domain.",
        "Released into the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form or by any means without the prior"
        " written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
NONE = "none"
#: Fixed ordinary sentences that hold a cue without being a licence.
ORDINARY = (
    "She renewed her driving license at the town hall in the morning.",
    "The pub lost its license to sell alcohol after the incident.",
    "He asked the teacher for permission to leave the room early.",
    "The fridge came with a two year warranty and free delivery.",
    "Copyright law is taught in the second year of the course.",
    "The fishing licence costs twenty pounds and is valid for a season.",
    "You need written permission from the council to build a garage.",
    "The court discussed the copyright of the song for three days.",
    "Her license plate was stolen from the car park last night.",
    "The manufacturer extended the warranty of all affected engines.",
    "Citizens have the right to vote and the right to assemble.",
    "The licensed electrician repaired the wiring of the old house.",
    "They were not licensed to carry passengers on the river.",
    "The data was redistributed among the remaining machines.",
)
#: A paragraph without any of these is no licence paragraph.
CUES = (
    "licens", "licenc", "copyright", "permission", "warrant", "redistribut", "public domain", "rights reserved",
    "creative commons", "spdx", "cc by", "cc0", "gpl", "proprietary",
)
#: What a text with a cue holds at least, even where a line end parts the words of a cue.
_TRACES = (*(c for c in CUES if " " not in c), "domain", "reserved", "commons")
#: Families whose templates hold those of others: a part of one is no notice of another.
_RELATED = (("gpl", "lgpl", "agpl"), ("cc-by", "cc-by-sa", "cc-by-nc"))
#: Words of a window around a cue, pairs of foreign words that may stand inside a notice, and least words of a notice.
_AROUND, _GAP, _LEAST = 12, 2, 3
_SPLIT = "[^a-z0-9]+"
#: The end of a sentence, and what stands for it: no notice goes beyond it.
_END, _STOP = "[.!?;]+(\\s|$)", " | | | "


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _cued(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(c) for c in CUES])


def _traced(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(c) for c in _TRACES]) | (text.contains("cc") & text.rlike("cc[^a-z0-9]+by"))


def _grams(words: Column, n: int) -> Column:
    last = F.size(words) - n
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def _features(df: DataFrame) -> DataFrame:
    df = df.withColumn("_words", _words(F.col("paragraph")))
    return df.withColumn("_grams", F.concat("_words", _grams(F.col("_words"), 2), _grams(F.col("_words"), 3)))


def training_fragments(spark: SparkSession) -> DataFrame:
    """(paragraph, family, fold): whole notices and windows of 5, 8 and 12 of their words, and ordinary sentences."""
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(NONE, t) for t in ORDINARY]
    one = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in rows])
    texts = spark.range(1).select(F.explode(one).alias("r")).select("r.*").withColumn("w", _words(F.col("text")))
    whole = texts.select(F.array_join("w", " ").alias("paragraph"), "family")
    parts = [whole, whole]
    for size in (5, 8, 12):
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)), F.lit(2))
        parts.append(
            texts.select("family", "w", F.explode(starts).alias("at")).select(
                F.array_join(F.slice("w", F.col("at"), size), " ").alias("paragraph"), "family"
            )
        )
    # a paragraph none of whose words are known is an ordinary one
    parts.append(spark.range(8).select(F.lit("").alias("paragraph"), F.lit(NONE).alias("family")))
    out = reduce(DataFrame.union, parts)
    return out.withColumn("fold", F.pmod(F.xxhash64("paragraph", "family"), F.lit(5)))


class LicenseModel:
    """The fitted vocabulary, regression, family names and threshold."""

    def __init__(self, spark: SparkSession, false_unknown: float = 0.02) -> None:
        self.names = [*sorted(TEMPLATES), NONE]
        label = F.array_position(F.array(*map(F.lit, self.names)), F.col("family")) - 1
        rows = _features(training_fragments(spark)).withColumn("label", label.cast("double"))
        self.vectors = CountVectorizer(inputCol="_grams", outputCol="_vector", binary=True, minDF=2.0).fit(rows)
        rows = self.vectors.transform(rows).select("_vector", "label", "fold").coalesce(1).cache()
        regression = LogisticRegression(featuresCol="_vector", labelCol="label", family="multinomial", regParam=2e-3, maxIter=40)
        first = regression.fit(rows.where("fold <> 0"))
        seen = first.transform(rows.where("fold = 0")).select(
            F.get(vector_to_array("probability"), F.col("label").cast("int")).alias("p"), "prediction", "label"
        )
        low = seen.where("prediction = label").agg(F.percentile("p", false_unknown)).first()[0]
        self.threshold = min(0.9, max(0.3, low or 0.3))
        self.regression = regression.fit(rows)
        rows.unpersist()

    def predict(self, paragraphs: DataFrame) -> DataFrame:
        """Add ``family``, ``probability`` and ``confirmed`` to rows with a string ``paragraph``."""
        rows = self.regression.transform(self.vectors.transform(_features(paragraphs)))
        rows = rows.withColumn("probability", F.array_max(vector_to_array("probability")))
        named = F.get(F.array(*map(F.lit, self.names)), F.col("prediction").cast("int"))
        rows = rows.withColumn("family", F.when(F.col("probability") >= self.threshold, named).otherwise("unknown"))
        spark = paragraphs.sparkSession
        own = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(" . ".join(t)).alias("text")) for f, t in TEMPLATES.items()])
        own = spark.range(1).select(F.explode(own).alias("r")).select(
            F.col("r.family").alias("family"), F.array_distinct(_grams(_words(F.col("r.text")), 2)).alias("_own")
        )
        # one row for each family
        rows = rows.join(F.broadcast(own), "family", "left").withColumn("_pairs", F.array_distinct(_grams(F.col("_words"), 2)))
        share = F.size(F.array_intersect("_pairs", "_own")) / F.greatest(F.size("_pairs"), F.lit(1))
        rows = rows.withColumn("confirmed", F.coalesce(share >= 0.5, F.lit(False)))
        return rows.select(*paragraphs.columns, "family", "probability", "confirmed")


def _template_pairs() -> list[str]:
    """The word pairs of all templates."""
    pairs = set()
    for text in (t for ts in TEMPLATES.values() for t in ts):
        for sentence in re.split(_END, text.lower()):
            words = [w for w in re.split(_SPLIT, sentence or "") if w]
            pairs.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
    return sorted(pairs)


def _stretches(paragraphs: DataFrame) -> DataFrame:
    """(_id, par, line, first, kind, paragraph): the stretches of template pairs in each paragraph that hold a cue.

    ``kind`` 0: a stretch with up to ``_GAP`` foreign pairs between its own, from the word ``first``; 1: one without any
    inside such a stretch.  ``line`` is the line on which it begins.
    """
    # words and their lines stay arrays of their own: a field of an array of structs would be taken out anew for each word
    words = F.transform(F.split(F.lower("text"), "\n"), lambda t: F.filter(F.split(F.regexp_replace(t, _END, _STOP), "[^a-z0-9|]+"), lambda w: w != ""))
    rows = paragraphs.select("_id", "par", words.alias("_s"))
    rows = rows.select("_id", "par", F.flatten("_s").alias("_w"), F.flatten(F.transform("_s", lambda ws, i: F.array_repeat(i, F.size(ws)))).alias("_l"))
    rows = rows.where(F.size("_w") >= _LEAST)
    known = _template_pairs()
    rows = rows.withColumn("_own", F.transform(F.slice("_w", 1, F.size("_w") - 1), lambda w, i: F.concat(w, F.lit(" "), F.get("_w", i + 1)).isin(known)))

    def runs(gap: int) -> Column:
        """(first, last): pairs that no own pair precedes, or follows, within ``gap`` foreign ones."""

        def edge(sign: int) -> Column:
            def lone(i: Column) -> Column:
                near = reduce(lambda a, b: a | b, [F.coalesce(F.get("_own", i + sign * g), F.lit(False)) for g in range(1, gap + 2)])
                return F.get("_own", i) & ~near

            return F.filter(F.sequence(F.lit(0), F.size("_own") - 1), lone)

        return F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last"))

    def both(kind: int, gap: int) -> Column:
        long = F.filter(runs(gap), lambda r: r["last"] - r["first"] + 2 >= _LEAST)
        return F.transform(long, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), F.lit(kind).alias("kind")))

    found = rows.select("_id", "par", "_w", "_l", F.explode(F.concat(both(0, _GAP), both(1, 0))).alias("_r")).withColumn("kind", F.col("_r.kind"))
    out = found.select(
        "_id", "par", F.get("_l", F.col("_r.first")).alias("line"), F.get("_l", F.col("_r.last") + 1).alias("line_to"), F.col("_r.first").alias("first"), F.col("_r.last").alias("last"), "kind",
        F.array_join(F.slice("_w", F.col("_r.first") + 1, F.col("_r.last") - F.col("_r.first") + 2), " ").alias("paragraph"),
    )
    return out.where(_cued(F.col("paragraph")))


def _windows(paragraphs: DataFrame) -> DataFrame:
    """(_id, par, line, paragraph): each line with a cue; of longer lines the windows of words around each cue."""
    lines = paragraphs.select("_id", "par", F.posexplode(F.split("text", "\n")).alias("line", "_text")).where(_cued(F.lower("_text")))
    lines = lines.select("_id", "par", "line", "_text", _words(F.col("_text")).alias("_w"))
    starts = [c.split(" ") for c in CUES]

    def at(i: Column) -> Column:
        """Whether a cue begins in the word ``i``."""
        hits = []
        for first, *more in starts:
            hit = F.get("_w", i).contains(first) if not more else F.get("_w", i).endswith(first)
            for n, w in enumerate(more, 1):
                hit = hit & F.coalesce(F.get("_w", i + n).startswith(w), F.lit(False))
            hits.append(hit)
        return reduce(lambda a, b: a | b, hits)

    hits = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), at)
    around = F.transform(hits, lambda i: F.array_join(F.slice("_w", F.greatest(i - _AROUND // 2, F.lit(0)) + 1, _AROUND), " "))
    short = F.size("_w") <= _AROUND
    return lines.select("_id", "par", "line", F.explode(F.when(short | (F.size("_w") == 0), F.array("_text")).otherwise(F.array_distinct(around))).alias("paragraph"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """(id, n_candidates, n_licenses, families, n_unknown, best_probability) of every whole text.

    A notice may be a part of a line or go over several lines of a paragraph (lines without a blank one between).
    ``n_candidates``: lines that hold a cue or begin a notice; ``families``: the confirmed families, sorted;
    ``n_licenses``: the confirmed notices, of one family once for a line; ``n_unknown``: candidates outside all
    confirmed notices that are not ordinary.  Texts that are null or have no cue have zeros and an empty array.  Rows
    that share an id are counted as one document; one row for each id.
    """
    model = model or LicenseModel(docs.sparkSession)
    kept = docs.where(_traced(F.lower(text_col))).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # rows that share an id keep paragraphs of their own
    paragraphs = kept.select("_id", F.xxhash64("_text").alias("_doc"), F.posexplode(F.split("_text", "\n[ \t\r]*\n")).alias("_n", "text"))
    paragraphs = paragraphs.select("_id", F.struct("_doc", "_n").alias("par"), "text").where(_traced(F.lower("text")))
    # the few paragraphs with a cue are read more than once
    paragraphs = saved(paragraphs, "license-paragraphs")
    no = F.lit(None).cast("int")
    stretches = _stretches(paragraphs)
    windows = _windows(paragraphs).select("_id", "par", "line", F.col("line").alias("line_to"), no.alias("first"), no.alias("last"), F.lit(2).alias("kind"), "paragraph")
    found = model.predict(stretches.unionByName(windows))
    found = found.withColumn("licensed", F.col("confirmed") & ~F.col("family").isin(NONE, "unknown"))
    notice = F.struct("kind", "first", "last", "line", "line_to", "family", "probability")
    grouped = found.groupBy("_id", "par").agg(
        F.collect_list(F.when(F.col("licensed"), notice)).alias("_all"),
        F.collect_list(F.when(F.col("kind") == 2, F.struct("line", "family"))).alias("_cues"),
    )
    related = [F.array(*map(F.lit, r)) for r in _RELATED]

    def inside(part: Column, whole: Column) -> Column:
        """Whether a confirmed stretch, or window, is told by one that holds it."""
        kin = reduce(lambda a, b: a | b, [F.array_contains(r, part["family"]) & F.array_contains(r, whole["family"]) for r in related])
        within = F.when(part["kind"] == 1, (part["first"] >= whole["first"]) & (part["last"] <= whole["last"])).otherwise(
            (part["line"] >= whole["line"]) & (part["line"] <= whole["line_to"])
        )
        return (whole["kind"] < part["kind"]) & within & (kin | (part["family"] == whole["family"]) | (part["kind"] == 2))

    told = grouped.withColumn("_own", F.filter("_all", lambda p: ~F.exists("_all", lambda w: inside(p, w))))
    told = told.withColumn("_own", F.array_distinct(F.transform("_own", lambda p: F.struct(p["line"].alias("line"), p["family"].alias("family")))))
    spare = F.filter("_cues", lambda c: (c["family"] != NONE) & ~F.exists("_all", lambda w: (c["line"] >= w["line"]) & (c["line"] <= w["line_to"])))
    lines = F.array_union(F.transform("_cues", lambda c: c["line"]), F.transform("_own", lambda c: c["line"]))
    told = told.select(
        "_id", F.size(lines).alias("_c"), F.size("_own").alias("_n"), F.col("_own.family").alias("_f"),
        F.size(F.array_distinct(F.transform(spare, lambda c: c["line"]))).alias("_u"), F.array_max(F.col("_all.probability")).alias("_p"),
    )
    sums = told.groupBy("_id").agg(
        F.sum("_c").alias("n_candidates"),
        F.sum("_n").alias("n_licenses"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_f")))).alias("families"),
        F.sum("_u").alias("n_unknown"),
        F.max("_p").alias("best_probability"),
    )
    ids = docs.select(id_col).distinct()
    out = ids.join(sums, ids[id_col].eqNullSafe(sums["_id"]), "left").drop("_id")
    return out.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_candidates", "n_licenses", "n_unknown")}
        | {"families": F.coalesce("families", F.array().cast("array<string>"))}
    )


def op4_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs)

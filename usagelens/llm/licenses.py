"""Licence scans with built-in expressions and Spark ML only.

A multinomial logistic regression with an L1 penalty on word pairs tells licence families and
an ``unknown`` class apart. It is trained here: on the templates and what is left of them
when words are missing, against texts that only speak of licences and a bounded sample of
paragraphs of the corpus. Its probabilities are calibrated on held-out rows by a temperature.
A predicted family is confirmed by comparing the paragraph with the family's templates and by the
word pairs that tell the family from its relatives (its version, Lesser, Affero, NC, SA, ND).

A paragraph is a line of a text, or neighbouring lines of a run without blank lines, so that a
notice may be wrapped. It starts and ends in a line with a feature, and there are at most ``REACH``
words between these two; lines without words do not count. A text without any word of the templates
that can tell them has no feature, is unknown by the model, and is not looked at further. Of
paragraphs that overlap, the one with the largest share of a template is reported, then the shortest.

Defined cases: null and empty texts have no paragraphs; repeated rows are scanned each; a null
``doc_id`` is kept; texts are read whole, whatever their length; an empty table gives no rows (the
model is then trained on the templates and fixed texts alone); other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import written

UNKNOWN = "unknown"
#: Documents whose paragraphs the unknown class is fitted on, by the hash of their id.
FIT_DOCUMENTS = 200
#: The least probability of a family, and the least share of a template's word pairs.
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.5
#: The end of a run: before a blank line. The parts of a text split there are the whole text.
_RUN_END = r"(?<=\n)(?=[^\S\n]*(?:\n|$))"

# The usual notices of each licence family.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License.",
    ),
    ("bsd", "Released under the BSD License."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met.",
    ),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Texts that speak of licences and name none of the families.
OTHERS = [
    "All rights reserved.",
    "See the license file for details.",
    "You need a license to drive this car.",
    "The work was released under pressure of the public.",
    "Licensed under a separate agreement with the publisher.",
    "This software is proprietary and confidential.",
    "Use of this file is subject to the terms of the contract.",
    "The general public was not admitted to the foundation.",
    "Version 2.0 of the program was released in May.",
    "Permission to use the room is granted by the office.",
]
# Notices of the families' nearest relatives; they are unknown.
RELATIVES = [
    "Licensed under the Apache License, Version 1.1.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 2 of the License.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation, either version 3 of the License.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3 of the License.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
]
_NUMBERS = ["1", "2", "3", "4", "international", "license", "licence"]
# Of each list of a family, one word pair at least is in every notice of it.
REQUIRED = {
    "apache-2.0": [["apache license"], ["version 2", "license 2", "v2 0", "v 2"]],
    "cc-by": [[f"{w} {n}" for w in ("by", "attribution") for n in _NUMBERS]],
    "cc-by-nc": [[f"{w} {n}" for w in ("nc", "noncommercial") for n in _NUMBERS]],
    "gpl-3.0": [["gnu general"], ["version 3", "license 3", "license v3", "v 3"]],
    "mpl-2.0": [["mozilla public"], ["version 2", "license 2", "v2 0", "v 2"]],
}
# Words that tell no licence.
STOP_WORDS = (
    "a and any are as by can either except following for form forms in is it may met not of on or person that the "
    "this to under use v version with without work you copy deal file files free charge code source terms "
    "published provided conditions following either 0 2 3 4"
).split()


def words(text: Column) -> Column:
    """Words of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pairs(found: Column) -> Column:
    """The distinct neighbouring words."""
    next_ = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(1)))
    joined = F.zip_with(found, next_, lambda a, b: F.concat_ws(" ", a, b))
    return F.when(
        F.size(found) > 1, F.array_distinct(F.slice(joined, 1, F.greatest(F.size(found) - 1, F.lit(1))))
    ).otherwise(F.array().cast("array<string>"))


def _plain_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _plain_pairs(text: str) -> list[str]:
    found = _plain_words(text)
    return [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


#: Words that tell something only beside the number that follows them.
_VERSION = ["v", "version"]


def _tells(pair: str) -> bool:
    first, second = pair.split()
    quiet = all(w in STOP_WORDS or w.isdigit() for w in (first, second))
    return not quiet or (first in _VERSION and second.isdigit())


#: The features: the word pairs of templates and relatives that have a word which tells something.
VOCABULARY = sorted({p for t in [*(t for _, t in TEMPLATES), *RELATIVES] for p in _plain_pairs(t) if _tells(p)})
_ANCHORS = sorted({w for p in VOCABULARY for w in p.split() if w not in STOP_WORDS and not w.isdigit()})
#: Every feature has one of these words.
TELLING = sorted([*_ANCHORS, *_VERSION])
#: By first letter, so that most places of a text fail at once.
_HAS_WORD = (
    r"(?i)(?<![a-z0-9])(?:"
    + "|".join(
        f"{first}(?:{'|'.join(w[1:] for w in _ANCHORS if w[0] == first)})" for first in sorted({w[0] for w in _ANCHORS})
    )
    + r")(?![a-z0-9])"
)
#: The most words between the first and the last line of a paragraph: twice the longest template.
REACH = 2 * max(len(_plain_words(t)) for _, t in TEMPLATES)
FAMILIES = [*sorted({f for f, _ in TEMPLATES}), UNKNOWN]


@dataclass
class Model:
    """Weights of each feature and family, intercepts, and the temperature."""

    weights: dict[str, list[float]]
    intercepts: list[float]
    temperature: float

    def scores(self, found: Column) -> Column:
        """The score of each family for word pairs."""
        start = F.array(*[F.lit(float(x)) for x in self.intercepts])
        if not self.weights:
            return start
        entries = [x for p, w in sorted(self.weights.items()) for x in (F.lit(p), F.array(*[F.lit(v) for v in w]))]
        table = F.create_map(*entries)
        own = F.array_intersect(found, F.array(*[F.lit(p) for p in sorted(self.weights)]))
        return F.aggregate(
            own, start, lambda s, p: F.zip_with(s, F.element_at(table, p), lambda a, b: a + b)
        )

    def probabilities(self, found: Column, temperature: float | None = None) -> Column:
        return _normed(_raised(self.scores(found), temperature or self.temperature))


def _raised(scores: Column, temperature: float) -> Column:
    return F.transform(scores, lambda s: F.exp((s - F.array_max(scores)) / temperature))


def _normed(raised: Column) -> Column:
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _rows(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(family, w) of given texts, whole, with one word missing, and cut at both ends."""
    given = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in texts])
    rows = spark.range(1).select(F.inline(given)).select("family", words(F.col("text")).alias("w"))
    n = F.size("w")
    missing = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.concat(F.slice("w", 1, i - 1), F.slice("w", i + 1, n))
    )
    cut = F.array(*[F.slice("w", 1 + a, F.greatest(n - a - b, F.lit(1))) for a in (0, 1, 2) for b in (0, 1, 2)])
    return rows.select("family", F.explode(F.concat(missing, cut)).alias("w"))


def training(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(family, found, held): labelled word pairs; every fourth row by hash is held out."""
    spark = docs.sparkSession
    ids = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        .where("doc_id is not null")
        .orderBy(F.xxhash64("doc_id"))
        .limit(fit_documents)
    )
    lines = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
        .select(F.explode(F.split("text", "\n")).alias("line"))
        .select(F.lit(UNKNOWN).alias("family"), words(F.col("line")).alias("w"))
        # a paragraph that shares more with a template than a phrase has no label
        .where(F.size("w") > 0)
        .where(F.size(F.array_intersect(pairs(F.col("w")), F.array(*[F.lit(p) for p in VOCABULARY]))) < 2)
    )
    known = _rows(spark, TEMPLATES).union(_rows(spark, [(UNKNOWN, t) for t in [*OTHERS, *RELATIVES]]))
    rows = known.union(lines).select("family", pairs(F.col("w")).alias("found"))
    return rows.withColumn("held", F.pmod(F.xxhash64("found"), F.lit(4)) == 0)


def train(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """The classifier: an L1-penalised fit, and the temperature that suits held-out rows best."""
    rows, _ = written(training(docs, fit_documents), "licenses-fit")
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    rows = rows.withColumn("label", label.cast("double"))
    vector = CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="found", outputCol="features", minTF=1)
    fitted = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=2e-3, maxIter=60).fit(
        vector.transform(rows.where(~F.col("held") | (F.size("found") == 0)).coalesce(1))
    )
    matrix = fitted.coefficientMatrix.toArray()
    used = [k for k in range(matrix.shape[1]) if abs(matrix[:, k]).max() > 1e-9]
    model = Model(
        {VOCABULARY[k]: matrix[:, k].tolist() for k in used}, fitted.interceptVector.toArray().tolist(), 1.0
    )
    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]
    right = F.col("label").cast("int") + 1
    held = rows.where("held")
    losses = held.agg(
        *[F.avg(-F.log(F.element_at(model.probabilities(F.col("found"), t), right) + 1e-9)) for t in grid]
    ).first()
    found = [(loss, t) for loss, t in zip(losses, grid, strict=True) if loss is not None and isfinite(loss)]
    model.temperature = min(found)[1] if found else 1.0
    return model


def _share(found: Column, family: Column) -> Column:
    """The largest share of the word pairs of one of the family's templates that is found."""
    shares = []
    for name, text in TEMPLATES:
        own = sorted(set(_plain_pairs(text)))
        shared = F.size(F.array_intersect(found, F.array(*[F.lit(p) for p in own]))) / len(own)
        shares.append(F.when(family == name, shared).otherwise(0.0))
    return F.greatest(*shares)


def _told(found: Column, family: Column) -> Column:
    """Whether the word pairs that the family requires are found."""
    told = F.lit(True)
    for name, lists in REQUIRED.items():
        for one in lists:
            has = F.arrays_overlap(found, F.array(*[F.lit(p) for p in one]))
            told = told & ((family != name) | has)
    return told


def _telling_parts(text: Column) -> Column:
    """array<struct<start, line>>: the parts of a text, split before blank lines, with a telling word."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,line:string>>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        telling = F.regexp_like(F.lower(part), F.lit(_HAS_WORD))
        own = F.array(F.struct(acc["at"].alias("start"), part.alias("line")))
        return F.struct(
            (acc["at"] + F.char_length(part)).alias("at"),
            F.when(telling, F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(F.split(text, _RUN_END, -1), begin, step, lambda a: a["found"])


def _marks(lines: Column) -> Column:
    """array<struct<start, end, before, upto, own>>: the lines with a feature.

    ``lines`` is array<struct<n, w, telling>>. ``before`` and ``upto`` count words of the run;
    ``own`` are the features that end in the line.
    """
    known = F.array(*[F.lit(p) for p in VOCABULARY])
    begin = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("before"),
        F.lit(None).cast("string").alias("last"),
        F.array().cast("array<struct<start:long,end:long,before:long,upto:long,own:array<string>>>").alias("found"),
    )

    def step(acc: Column, line: Column) -> Column:
        n = F.size(line["w"])
        across = F.concat_ws(" ", acc["last"], F.get(line["w"], F.lit(0)))
        crossing = (n > 0) & acc["last"].isNotNull() & F.array_contains(known, across)
        own = F.when(line["telling"], F.array_intersect(pairs(line["w"]), known)).otherwise(
            F.array().cast("array<string>")
        )
        # a pair across a line end is a feature of the line it ends in
        own = F.when(crossing, F.concat(own, F.array(across))).otherwise(own)
        mark = F.struct(
            acc["at"].alias("start"),
            (acc["at"] + line["n"]).alias("end"),
            acc["before"].alias("before"),
            (acc["before"] + n).alias("upto"),
            own.alias("own"),
        )
        return F.struct(
            (acc["at"] + line["n"] + 1).alias("at"),
            (acc["before"] + n).alias("before"),
            F.when(n > 0, F.element_at(line["w"], -1)).otherwise(acc["last"]).alias("last"),
            F.when(line["telling"] | crossing, F.concat(acc["found"], F.array(mark))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(lines, begin, step, lambda a: a["found"])


def _windows(marks: Column, start: Column, part: Column) -> Column:
    """array<struct<start, line>>: each marked line, and neighbouring lines that hold features together."""

    def of(first: Column, k: Column) -> Column:
        near = F.filter(F.slice(marks, k + 1, REACH + 2), lambda m: m["before"] - first["upto"] <= REACH)
        # the last line adds a feature, or the window is the line alone
        wide = F.filter(
            F.transform(near, lambda m, i: F.struct(m.alias("last"), i.alias("i"))),
            lambda x: (x["i"] == 0) | (F.size(x["last"]["own"]) > 0),
        )
        return F.transform(
            wide,
            lambda x: F.struct(
                (start + first["start"]).alias("start"),
                F.substring(
                    part, (first["start"] + 1).cast("int"), (x["last"]["end"] - first["start"]).cast("int")
                ).alias("line"),
            ),
        )

    return F.flatten(F.transform(marks, of))


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(__row, start, end, family, probability, share): paragraphs with a telling word.

    ``docs`` has ``__row`` and ``text``; a row without such a paragraph gives one row of nulls, and
    one whose share of every template is too small has no family. Positions are in code points.
    """
    looked = F.when(F.regexp_like(F.lower("text"), F.lit(_HAS_WORD)), _telling_parts(F.col("text")))
    rows = docs.select("__row", F.explode_outer(looked).alias("p"))
    rows = rows.select("__row", F.col("p.start").alias("start"), F.col("p.line").alias("part"))
    lines = F.transform(
        F.split("part", "\n", -1),
        lambda x: F.struct(
            F.char_length(x).alias("n"),
            words(x).alias("w"),
            F.regexp_like(F.lower(x), F.lit(_HAS_WORD)).alias("telling"),
        ),
    )
    rows = rows.withColumn("lines", lines).withColumn("marks", _marks(F.col("lines")))
    rows = rows.select("__row", F.explode_outer(_windows(F.col("marks"), F.col("start"), F.col("part"))).alias("p"))
    rows = rows.select("__row", "p.start", "p.line", pairs(words(F.col("p.line"))).alias("found"))
    rows = rows.withColumn("near", F.greatest(*[_share(F.col("found"), F.lit(f)) for f in FAMILIES[:-1]]))
    # a column a step: inside a lambda the step before would be worked out for every family
    rows = rows.withColumn("scores", F.when(F.col("near") >= LEAST_SHARE, model.scores(F.col("found"))))
    rows = rows.withColumn("raised", _raised(F.col("scores"), model.temperature))
    rows = rows.withColumn("ps", _normed(F.col("raised")))
    best = F.array_max("ps")
    names = F.array(*[F.lit(f) for f in FAMILIES])
    rows = rows.withColumn("probability", best).withColumn(
        "family", F.element_at(names, F.array_position("ps", best).cast("int"))
    )
    return rows.select(
        "__row",
        "start",
        (F.col("start") + F.char_length("line")).alias("end"),
        "family",
        "probability",
        F.when(_told(F.col("found"), F.col("family")), _share(F.col("found"), F.col("family")))
        .otherwise(0.0)
        .alias("share"),
    )


def _apart(hits: Column) -> Column:
    """Of hits that overlap, the one with the largest share, then the shortest, then the first; in order."""
    ranked = F.array_sort(
        F.transform(
            hits,
            lambda h: F.struct((-h["share"]).alias("rank"), (h["end"] - h["start"]).alias("n"), h["start"].alias("start"), h.alias("h")),
        )
    )
    kind = "array<struct<start:long,end:long,family:string,probability:double,share:double>>"

    def step(acc: Column, r: Column) -> Column:
        over = F.exists(acc, lambda o: (o["start"] < r["h"]["end"]) & (o["end"] > r["h"]["start"]))
        return F.when(over, acc).otherwise(F.concat(acc, F.array(r["h"])))

    return F.array_sort(F.aggregate(ranked, F.array().cast(kind), step))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_licenses, families, spans, least_probability), one row per document.

    A licence is a paragraph whose family is not unknown, probable enough and confirmed by a
    template. ``families`` are distinct and sorted, ``spans`` are family:start:end in order.
    """
    model = model or train(docs)
    marked = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("k")).alias("__row"),
        F.col("text"),
    )
    sure = (
        (F.col("family") != UNKNOWN)
        & (F.col("probability") >= LEAST_PROBABILITY)
        & (F.col("share") >= LEAST_SHARE)
    )
    found = paragraphs(marked, model).select(
        "__row", F.when(sure, F.struct("start", "end", "family", "probability", "share")).alias("hit")
    )
    # a document's rows are neighbours in one task; hits of one document are few paragraphs
    rows = found.groupBy("__row").agg(F.collect_list("hit").alias("hits")).withColumn("hits", _apart(F.col("hits")))
    named = F.transform("hits", lambda h: F.concat_ws(":", h["family"], h["start"], h["end"]))
    return rows.select(
        F.col("__row.doc_id").alias("doc_id"),
        F.size("hits").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["family"]))), ",").alias("families"),
        F.array_join(named, ",").alias("spans"),
        F.array_min(F.transform("hits", lambda h: h["probability"])).alias("least_probability"),
    )

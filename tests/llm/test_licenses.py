"""Licence scans: every notice found, other texts left alone, odd rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from usagelens.llm import licenses

DOCS = "doc_id long, text string"
# The licence lines of the test tables.
LINES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return licenses.train(docs)


def test_documents(docs, model):
    got = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    total = 0
    for r in rows:
        want, at = [], 0
        for line in r.text.split("\n"):
            if line in LINES:
                want.append(f"{LINES[line]}:{at}:{at + len(line)}")
            at += len(line) + 1
        total += len(want)
        assert got[r.doc_id].spans == ",".join(want), r.doc_id
        assert got[r.doc_id].n_licenses == len(want)
    assert total >= 10


def test_held_out_texts(spark, model):
    """Notices in other words than those trained on; texts about licences; noise."""
    known = [
        ("apache-2.0", "This project is licensed under the Apache License, Version 2.0"),
        ("mit", "The code is released under the MIT License, see below"),
        ("gpl-3.0", "this work is licensed under the gnu general public license version 3 only"),
        ("cc-by-nc", "Text licensed under CC BY-NC 4.0, images too"),
        ("bsd", "* Redistribution and use in source and binary forms, with or without changes, are permitted"),
    ]
    other = ["A driving license is valid for years", "The MIT campus", "Apache version two", "public " * 50, "license"]
    rows = [(i, t) for i, (_, t) in enumerate(known)] + [(100 + i, t) for i, t in enumerate(other)]
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame(rows, DOCS), model).collect()}
    assert [got[i] for i in range(len(known))] == [f for f, _ in known]
    assert all(got[100 + i] == "" for i in range(len(other)))


def test_features_match_plain_python(spark):
    texts = ["", "One", "a-b C. d", "Version 2.0 of the the the", "é license ü MIT"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(licenses.pairs(licenses.words(F.col("t")))).collect()]
    assert got == [list(dict.fromkeys(licenses._plain_pairs(t))) for t in texts]
    assert all(any(w in licenses.TELLING for w in p.split()) for p in licenses.VOCABULARY)
    assert re.search(licenses._HAS_WORD, "the MIT, ") and not re.search(licenses._HAS_WORD, "emits")


def test_odd_rows(spark, model):
    line = "Released under the MIT License."
    rows = [(None, line), (1, None), (2, ""), (3, line), (3, line), (4, "word " * 50_000 + "\n" + line), (5, f"\n\n{line}\n{line}")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", family int")
    got = sorted((r.doc_id or 0, r.n_licenses, r.spans) for r in licenses.scan(docs, model).collect())
    n = len(line)
    assert got == [
        (0, 1, f"mit:0:{n}"), (1, 0, ""), (2, 0, ""), (3, 1, f"mit:0:{n}"), (3, 1, f"mit:0:{n}"),
        (4, 1, f"mit:250001:{250001 + n}"), (5, 2, f"mit:2:{2 + n},mit:{3 + n}:{3 + 2 * n}"),
    ]
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_native(docs, model):
    plan = licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
    "of this software and associated documentation files (the \"Software\"), to deal\n"
    "in the Software without restriction",
    "bsd": " * Redistribution and use in source and binary forms,\n * with or without modification, are permitted\n"
    " *\n * provided that the following conditions are met",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify\n"
    "it under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License",
}


def test_wrapped_notices(spark, model):
    """A notice over several lines is found, its span in code points from its first to its last line."""
    rows, want = [], []
    for k, (family, notice) in enumerate(WRAPPED.items()):
        for j, (before, after) in enumerate([("", ""), ("é🙂 first\n\n", "\n\nlast"), ("A line é.\n", "\nAnother line.\n")]):
            rows.append((10 * k + j, before + notice + after))
            want.append((10 * k + j, f"{family}:{len(before)}:{len(before + notice)}"))
    got = sorted((r.doc_id, r.spans) for r in licenses.scan(spark.createDataFrame(rows, DOCS), model).collect())
    assert got == want
    both = "\n\n".join(WRAPPED.values()) + "\nReleased under the\nMIT License."
    apart = [(1, both), (2, WRAPPED["mit"].replace("\n", "\n\n"))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(apart, DOCS), model).collect()}
    assert [s.split(":")[0] for s in got[1].spans.split(",")] == [*WRAPPED, "mit"]
    assert got[2].spans == ""


def test_near_relatives(spark, model):
    """Other versions and relatives of a family are not reported as the family."""
    known = {
        "This work is licensed under the GNU General Public License,\nversion 3.": "gpl-3.0",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Licensed under CC BY 4.0.": "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        WRAPPED["gpl-3.0"]: "gpl-3.0",
    }
    others = [*licenses.RELATIVES, WRAPPED["gpl-3.0"].replace("version 3", "version 2")]
    others += [WRAPPED["gpl-3.0"].replace("GNU", f"GNU {w}") for w in ("Lesser", "Affero")]
    rows = list(enumerate([*known, *others]))
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame(rows, DOCS), model).collect()}
    assert [got[i] for i, _ in rows] == [*known.values()] + [""] * len(others)

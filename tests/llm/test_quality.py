"""Quality classifier: held-out accuracy, shrinkage, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import quality

DOCS = "doc_id long, text string, source string, lang string"
SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    held = labels.where("doc_id % 3 = 0")
    rows = quality.classify(docs, seen).join(held, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [not r.kept for r in rows if r.quality == 0]
    assert len(good) > 500 and len(bad) > 80
    assert sum(good) / len(good) >= 0.99
    assert sum(bad) / len(bad) >= 0.9


def test_sites_by_hand(spark):
    """Many documents at a site speak for themselves, few are shrunk towards what is above."""
    rows = [("a", "x", 0.9)] * 400 + [("b", "x", 0.1)] * 400 + [("c", "x", 0.1), ("a", "y", 0.1), (None, None, 0.5)]
    evidence = spark.createDataFrame(rows, "host string, path string, p double")
    priors, (rate, host_weight, path_weight) = quality.sites(evidence)
    got = {(r.host, r.path): r for r in priors.collect()}
    assert rate == pytest.approx((400 * 0.9 + 400 * 0.1 + 0.1 + 0.1 + 0.5) / 803)
    assert (got["a", "x"].good, got["a", "x"].n) == (pytest.approx(360), 400)
    for host, good, n in (("a", 360.1, 401), ("b", 40, 400), ("c", 0.1, 1), (None, 0.5, 1)):
        prior = next(r.prior for r in got.values() if r.host == host)
        assert prior == pytest.approx((host_weight * rate + good) / (host_weight + n))
    assert 2 <= host_weight < 10 and path_weight >= 2
    spread = sum(n * (g / n - rate) ** 2 for g, n in ((360.1, 401), (40, 400), (0.1, 1), (0.5, 1))) / 803
    chance = 4 * rate * (1 - rate) / 803
    weight = rate * (1 - rate) / (spread - chance) - 1
    assert host_weight == pytest.approx(min(max(weight, 2.0), 1000.0))


def test_posterior_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.classify(docs, labels).collect()
    where = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    own = {r.doc_id: r.own_probability for r in rows}
    priors, (rate, _, weight) = quality.sites(
        spark.createDataFrame([(*where[d], p) for d, p in own.items()], "host string, path string, p double")
    )
    site = {(r.host, r.path): r for r in priors.collect()}
    logit = lambda p: math.log(p / (1 - p))
    for r in rows:
        s = site[where[r.doc_id]]
        left = (weight * s.prior + s.good - r.own_probability) / (weight + s.n - 1)
        left = min(max(left, 1e-6), 1 - 1e-6)
        z = logit(r.own_probability) + logit(left) - logit(rate)
        assert r.probability == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
        assert r.kept == (r.probability >= 0.5)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "s", None), (1, "", "s", None), (2, "x " * 90_000, None, "en"), (3, "a b.", "s", "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], DOCS + ", `__p` double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels)
    assert out.count() == 5 and out.where(F.col("probability").isNull()).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(str, quality.keep_good(docs, none).collect())) == sorted(map(str, docs.collect()))
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, quality.WIDTH))
    good = (x[:, 3] + 0.1 * rng.normal(size=500) > 0).astype(float)
    mean, scale, w = quality.fit(x, good)
    assert ((((x - mean) / scale) @ w[:-1] + w[-1] > 0) == good).mean() > 0.95

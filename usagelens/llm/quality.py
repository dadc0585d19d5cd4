"""Quality classifier: a document's own evidence and hierarchical empirical Bayes over its site.

A logistic regression on the shape of a text gives each document a probability of being good.
Hosts and paths gather these probabilities by grouped aggregation; a host's rate is shrunk
towards the global rate and a path's rate towards its host's, the sparser the more. How strong
the shrinkage is (the concentration of the beta prior) is estimated from the spread of the
sites' rates by moments. A document's posterior moves its own log-odds by those of its path against
the global ones; its own share is taken out of its site first.

In the table of documents ``source`` is the host and ``lang`` the first part of the path.

Defined cases: a null, empty or blank text has the features of an empty text; null hosts and
paths are sites of their own; labels that are null or repeated count by their largest value, and
without usable labels every document's own evidence is even (0.5), so all stay at the default
threshold; a null ``doc_id`` is classified like any other; repeated rows count each; empty tables
give empty results; texts are described whole, whatever their length; a probability that equals the
threshold keeps its document; other columns pass through ``keep_good`` whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import in_parts, lean, written

#: Labelled documents the classifier is fitted on at most, taken by the hash of their id.
FIT_ROWS = 20_000
THRESHOLD = 0.5
#: The least and most prior weight of a site, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0
_SHARES = 14


def features(text: str | None) -> list[float]:
    """The shape of a whole text: shares of character kinds, lengths, and repetition of words."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower, digit = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum()
    marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    stops = raw[[33, 44, 46, 58, 59, 63]].sum()
    size = max(1, raw.sum())
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" or not w[0].isalnum() for w in words)
    return [
        upper / size,
        lower / size,
        digit / size,
        (marks - stops) / size,
        stops / size,
        raw[33] / size,
        raw[10] / size,
        raw[128:].sum() / size,
        len(text) / 8 / (n + len(text) / 8),
        len(counts) / n,
        top / n,
        same / n,
        caps / n,
        odd / n,
        np.log1p(chars) / 10,
    ]


WIDTH = _SHARES + 1


def fit(rows: np.ndarray, good: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a logistic regression, by Newton steps."""
    if not len(rows) or good.min() == good.max():
        return np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.concatenate([(rows - mean) / scale, np.ones((len(rows), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = ridge * len(rows) * np.eye(len(w))
    penalty[-1, -1] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + penalty, x.T @ (good - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def trained(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS):
    """The model, fitted on ``fit_rows`` labelled documents at most.

    The sample (so many ids, which bounds what is broadcast and what comes to the driver as a
    few numbers a row) is taken by the hash of the id.
    """
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(target).cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(one), "doc_id")

    schema = pa.schema([("good", pa.int32()), ("x", pa.list_(pa.float64()))])

    def shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            x = pa.array([features(t) for t in batch.column(1).to_pylist()], schema.field("x").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), x], schema=schema)

    rows = sample.select("good", "text").mapInArrow(lean(shapes), "good int, x array<double>")
    # ids may be repeated in the documents: the bound holds for rows too
    found = rows.limit(2 * fit_rows).toArrow()
    x = np.array(found.column("x").to_pylist()).reshape(-1, WIDTH)
    return fit(x, found.column("good").to_numpy().astype(float))


def own_evidence(model) -> object:
    """A function of the text column: the classifier's probability, not quite 0 or 1."""
    mean, scale, w = model

    def shapes(texts: pa.Array) -> np.ndarray:
        coded = texts.fill_null("").dictionary_encode()
        known = np.array([features(t.as_py()) for t in coded.dictionary]).reshape(-1, WIDTH)
        return known[coded.indices.to_numpy()]

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        x = shapes(texts)
        pa.default_memory_pool().release_unused()
        logit = np.clip((x - mean) / scale @ w[:-1] + w[-1], -12, 12)
        return pa.array(1 / (1 + np.exp(-logit)))

    return probability


def _weight(mean: Column, between: Column) -> Column:
    """The beta prior's weight for rates with this mean and variance between sites."""
    weight = mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1
    return F.least(F.greatest(weight, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))


def _spread(rates: DataFrame, around: Column) -> Column:
    """The variance of the sites' true rates: the observed one, weighted by documents, less
    what chance adds to it."""
    n = F.sum("n")
    seen = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - around, 2)) / n
    chance = F.sum(around * (1 - around)) / n
    return F.greatest(seen - chance, F.lit(0.0))


def sites(evidence: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
    """Paths with their shrunk prior, and (global rate, host weight, path weight).

    ``evidence`` has host, path and p. The result is (host, path, prior, weight, good, n): the
    host's posterior, the weight it has for the path, and what the path has gathered. Documents
    are summed up by path before anything else sees them.
    """
    paths, _ = written(
        evidence.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").cast("double").alias("n")),
        "quality-paths",
    )
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    rate = total[0] / total[1] if total[1] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    spread = hosts.agg(_weight(F.lit(rate), _spread(hosts, F.lit(rate)))).first()[0]
    host_weight = spread if spread is not None else LEAST_WEIGHT
    of_hosts, _ = written(
        hosts.select("host", ((host_weight * rate + F.col("good")) / (host_weight + F.col("n"))).alias("prior")),
        "quality-hosts",
    )
    joined, _ = written(
        paths.alias("p")
        .join(of_hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")))
        .select("p.host", "p.path", "prior", "good", "n"),
        "quality-sites",
    )
    inside = joined.agg(_weight(F.lit(rate), _spread(joined, F.col("prior")))).first()[0]
    path_weight = inside if inside is not None else LEAST_WEIGHT
    return joined, (rate, host_weight, path_weight)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _scored(docs: DataFrame, labels: DataFrame, host: str, path: str, kept: list[Column]) -> DataFrame:
    """The kept columns with ``__own``, ``__site`` and ``__p`` of every document."""
    probability = own_evidence(trained(docs, labels))
    site = [F.col(host).cast("string").alias("__host"), F.col(path).cast("string").alias("__path")]
    evidence = docs.select(
        F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), probability("text").alias("p")
    )
    priors, (rate, _, weight) = sites(evidence)
    priors = priors.select(F.col("host").alias("__h"), F.col("path").alias("__q"), "prior", "good", "n")
    own = F.col("__own")
    rows = docs.select(*kept, *site, probability("text").alias("__own"))
    same = F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__q"))
    left_out = (weight * F.col("prior") + F.col("good") - own) / (weight + F.col("n") - 1)
    bounded = F.least(F.greatest(left_out, F.lit(1e-6)), F.lit(1 - 1e-6))
    middle = min(max(rate, 1e-6), 1 - 1e-6)
    shifted = _logit(own) + _logit(F.col("__site")) - _logit(F.lit(middle))
    return (
        rows.join(priors, same)
        .withColumn("__site", bounded)
        .withColumn("__p", 1 / (1 + F.exp(-shifted)))
        .drop("__host", "__path", "__h", "__q", "prior", "good", "n")
    )


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, own_probability, site_rate, probability, kept), one row per document."""
    scored = _scored(docs, labels, host, path, [F.col("doc_id").cast("long").alias("doc_id")])
    return scored.select(
        "doc_id",
        F.col("__own").alias("own_probability"),
        F.col("__site").alias("site_rate"),
        F.col("__p").alias("probability"),
        (F.col("__p") >= threshold).alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that are kept, all columns as they were."""
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("__row")
    scored = _scored(docs, labels, host, path, [row])
    return scored.where(F.col("__p") >= threshold).select("__row.*")

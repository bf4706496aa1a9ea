"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. Every document gets a probability of being good from a logistic regression
   on a few text statistics.  It is fitted on at most ``SAMPLE`` labelled rows
   (a documented bound; the rows of least id hash).
2. A site's evidence is the labels of its labelled documents and the probabilities of
   the others, summed per path and per host by grouped aggregation (in whole decimal
   numbers, so that sums neither overflow nor depend on the order of rows).
3. The global mean and the spread of hosts around it, and of paths around their
   hosts, are estimated from the sums by moments.  They give Beta priors: a
   host's posterior mean shrinks toward the global mean, a path's toward its
   host's, the more the fewer documents it has.
4. A document's odds are multiplied by the odds of its path against the global
   odds; its own evidence is left out of the sums of its path and of its host.

Defined results: a null or empty text has all statistics 0; a null host or path
is a site of its own; without labels of both classes the classifier says 0.5 for
every document, which keeps it; repeated labels of an id count once, as good if
any is; repeated rows each get their row; empty tables give no rows; extra
columns pass through ``keep`` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKEN, boxed, materialize, unboxed

SAMPLE = 20_000
#: A document goes if it is four times as likely to be bad as to be good.
THRESHOLD = 0.2
_UNIT = 1_000_000_000
_NONE = "\u0000"


def features(text: Column) -> dict[str, Column]:
    """Statistics of a text, each of a bounded range."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda p: F.length(F.regexp_replace(t, f"[^{p}]+", ""))
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "distinct_share": F.size(F.array_distinct(words)) / F.sqrt(n),
        "word_chars": F.least(F.length(F.array_join(words, "")) / n, F.lit(30.0)),
        "symbols": F.least(count("#*$%&|<>") / n, F.lit(4.0)),
        "marks": F.least(count("!?") / n, F.lit(4.0)),
        "capitals": count("A-Z") / chars,
        "digits": count("0-9") / chars,
        "dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1)),
        "repeats": 1 - F.size(F.array_distinct(words)) / n,
    }


NAMES = ("log_words", "distinct_share", "word_chars", "symbols", "marks", "capitals", "digits", "dup_lines", "repeats")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; bias first, on raw features."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(len(NAMES) + 1)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    raw = w[1:] / scale
    return np.r_[w[0] - raw @ mean, raw]


def probability(weights, columns: dict[str, Column]) -> Column:
    """The classifier's probability in billionths, as a whole number."""
    score = F.lit(float(weights[0]))
    for w, name in zip(weights[1:], NAMES):
        score = score + F.lit(float(w)) * columns[name]
    score = F.greatest(F.lit(-15.0), F.least(F.lit(15.0), score))
    return F.round(F.lit(float(_UNIT)) / (1 + F.exp(-score))).cast("long")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: float, spread: float, noise: float) -> float:
    """Pseudo-documents of a Beta prior with this mean whose variance is ``spread - noise``."""
    between = max(spread - noise, 1e-6)
    return float(min(max(mean * (1 - mean) / between - 1, 2.0), 10_000.0))


class Model:
    """A fitted classifier with the sums of all sites (a written table) and the known labels."""

    def __init__(self, weights, sites: DataFrame, known: DataFrame, mean: float, host_strength: float, path_strength: float):
        self.weights, self.sites, self.known, self.mean = weights, sites, known, mean
        self.host_strength, self.path_strength = host_strength, path_strength

    def _joined(self, docs: DataFrame, p: Column) -> DataFrame:
        known = self.known.withColumnRenamed("_k", "_known")
        return docs.withColumn("_p", p).join(known, F.col("_key") == F.col("_known"), "left").join(self.sites, ["_host", "_path"], "left")

    def _verdict(self, label: Column) -> dict[str, Column]:
        """What joined documents get if this is their label."""
        evidence = _evidence(F.col("_p"), label)
        without = lambda s: (F.greatest(F.col(s) - evidence, F.lit(0)) / _UNIT).cast("double")
        others = lambda n: F.greatest(F.col(n) - 1, F.lit(0))
        edge = lambda c, e: F.greatest(F.lit(e), F.least(F.lit(1 - e), c))
        host = (without("_host_p") + self.host_strength * self.mean) / (others("_host_n") + self.host_strength)
        host = F.coalesce(host, F.lit(self.mean))
        path = (without("_path_p") + self.path_strength * host) / (others("_path_n") + self.path_strength)
        path = edge(F.coalesce(path, F.lit(self.mean)), 1e-6)
        classifier = F.col("_p") / _UNIT
        odds = _logit(edge(classifier, 1e-7)) + _logit(path) - _logit(F.lit(self.mean))
        return {"classifier": classifier, "host_posterior": host, "path_posterior": path, "quality": F.round(1 / (1 + F.exp(-odds)), 9)}

    def score(self, docs: DataFrame, p: Column) -> DataFrame:
        """Join the sites to documents with ``_key``, ``_host`` and ``_path``; add the verdict."""
        return (self._joined(docs, p).withColumns(self._verdict(F.col("_y")))
                .drop("_p", "_y", "_known", "_path_n", "_path_p", "_host_n", "_host_p"))

    def deciding(self, narrow: DataFrame, p: Column, threshold: float) -> DataFrame:
        """The known labels without which a document would be kept and is not, or the other way round.

        A label only tells what is left out of the sums of the document's site, which moves its verdict the less the
        more documents the site has: so the number of these labels grows with the sites and not with the documents.
        """
        kept = lambda y: self._verdict(y)["quality"] >= threshold
        changed = ~kept(F.col("_y")).eqNullSafe(kept(F.lit(None).cast("int")))
        return self._joined(narrow, p).where(changed).select(F.col("_key").alias("_k"), "_y").distinct()


def _evidence(p: Column, label: Column) -> Column:
    """What a document tells of its site, in billionths: its label, or its probability where it has none."""
    return F.when(label.isNotNull(), label.cast("long") * _UNIT).otherwise(p).cast("decimal(20,0)")


def _site(host: Column, path: Column) -> dict[str, Column]:
    return {"_host": F.coalesce(host.cast("string"), F.lit(_NONE)), "_path": F.coalesce(path.cast("string"), F.lit(_NONE))}


def train(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model, and the documents' key, site and statistics as a written table."""
    columns = _site(host, path) | features(F.col(text))
    narrow = materialize(docs.select(F.col(key).alias("_key"), *(c.alias(n) for n, c in columns.items())), "features")
    known = materialize(labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
                        .groupBy(F.col(key).alias("_k")).agg((F.max("quality") >= 1).cast("int").alias("_y")), "known")
    labelled = narrow.join(known, F.col("_key") == F.col("_k")).select(F.xxhash64("_key").alias("h"), "_key", "_y", *NAMES)
    # Hashes are even over 64 bits: below this bound stand a few more rows than the sample, so that tasks send no more.
    share = min(1.0, 1.2 * (sample + 100) / max(labelled.count(), 1))
    bound = F.lit(min(int((share - 0.5) * 2**64), 2**63 - 1))
    rows = labelled.where(F.col("h") <= bound).orderBy("h", "_key", *NAMES).limit(sample).toPandas()
    weights = fit(rows[list(NAMES)].to_numpy(float), rows["_y"].to_numpy(float))
    p = probability(weights, {n: F.col(n) for n in NAMES})
    evidence = narrow.select("_key", "_host", "_path", p.alias("_p")).join(known, F.col("_key") == F.col("_k"), "left")
    paths = materialize(evidence.groupBy("_host", "_path").agg(F.count("*").alias("_path_n"), F.sum(_evidence(F.col("_p"), F.col("_y"))).alias("_path_p")),
                        "paths")
    hosts = materialize(paths.groupBy("_host").agg(F.sum("_path_n").alias("_host_n"), F.sum("_path_p").alias("_host_p")), "hosts")
    total = hosts.agg(F.sum("_host_n").alias("n"), F.sum("_host_p").alias("s")).first()
    mean = min(max(float(total["s"]) / total["n"] / _UNIT, 0.01), 0.99) if total["n"] else 0.5
    share = lambda s, n: (F.col(s) / _UNIT).cast("double") / F.col(n)

    # Moments over sites of at least two documents: the spread of their means, and the part of it that chance makes.
    def moments(sites: DataFrame, own: Column, n: str, around: Column) -> float:
        # Rounded to billionths before the sums, so that the order of rows cannot show.
        whole = lambda c: F.sum(F.round(c * _UNIT).cast("decimal(20,0)"))
        m = sites.where(F.col(n) >= 2).agg(F.count("*").alias("k"), whole((own - around) ** 2).alias("v"),
                                           whole(around * (1 - around) / F.col(n)).alias("e")).first()
        return _strength(mean, float(m["v"]) / m["k"] / _UNIT, float(m["e"]) / m["k"] / _UNIT) if m["k"] else 10.0

    host_strength = moments(hosts, share("_host_p", "_host_n"), "_host_n", F.lit(mean))
    joined = materialize(paths.join(hosts, "_host"), "sites")
    posterior = ((F.col("_host_p") / _UNIT).cast("double") + host_strength * mean) / (F.col("_host_n") + host_strength)
    path_strength = moments(joined, share("_path_p", "_path_n"), "_path_n", posterior)
    return Model(weights, joined, known, mean, host_strength, path_strength), narrow


def classify(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(key, classifier, host_posterior, path_posterior, quality, kept) per document."""
    model, narrow = train(docs, labels, host=host, path=path, key=key, text=text, sample=sample)
    scored = model.score(narrow, probability(model.weights, {n: F.col(n) for n in NAMES}))
    return scored.withColumn("kept", F.col("quality") >= threshold).withColumnRenamed("_key", key).drop("_host", "_path", *NAMES)


def keep(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, key: str = "doc_id", text: str = "text",
         threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents the classifier keeps, with their own columns."""
    model, narrow = train(docs, labels, host=host, path=path, key=key, text=text, sample=sample)
    # Only these meet the whole texts, so that the texts need no shuffle for labels that decide nothing.
    model.known = materialize(model.deciding(narrow, probability(model.weights, {n: F.col(n) for n in NAMES}), threshold), "deciding")
    rows = boxed(docs, **_site(host, path), _key=F.col(key), _p=probability(model.weights, features(F.col(text))))
    return unboxed(model.score(rows, F.col("_p")).where(F.col("quality") >= threshold), docs.columns)

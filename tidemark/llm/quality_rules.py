"""Quality rules whose cutoffs carry a proven limit on false rejection.

Each rule is a statistic of a text that is high for bad texts.  A labelled
holdout gives, for every stratum, rule and cutoff of a grid, the number of good
texts the cutoff would reject.  The exact binomial tail of that count is a
p-value for "the cutoff rejects more than ``alpha / rules`` of the good texts".
Cutoffs of one rule are tested from lenient to strict and the first failure
ends the sequence, so no correction is due within a rule; strata and rules are
corrected by Bonferroni.  Among the certified cutoffs the one that best tells
bad from good holdout texts is taken, a good text lost counting ``good_cost``
times a bad one caught (ties: the most lenient).

Everything is a DataFrame expression.  Defined results:

* null or empty text: all counts 0, so it fails the base rule;
* null stratum: a stratum of its own; a stratum without enough labelled texts
  has no certified cutoff and rejects by the base rule only;
* repeated labels of one id: good if any of them says so; null labels or ids
  are ignored; repeated documents each get their row;
* tables without rows give no rows; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKEN, materialize

#: Rule -> cutoff grid from lenient to strict.  A text is rejected above it.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05),
    "repeat_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "dup_lines_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "mean_word_chars": (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0),
}


def _has_twin(ordered: Column, key):
    """A test for F.filter: the element's key equals that of a neighbour in ``ordered``."""
    return lambda x, i: (
        F.coalesce(key(F.get(ordered, i + 1)) == key(x), F.lit(False))
        | ((i > 0) & F.coalesce(key(F.get(ordered, i - 1)) == key(x), F.lit(False)))
    )


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated three-word windows are found inside each text by sorting its
    window hashes with their positions, so no text is spread over rows.  Equal
    hashes are then compared as words, so hash collisions do not count.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(
        "*",
        F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)).alias("_w"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    w = F.col("_w")
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    second = first.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    ).drop("_lines")
    h = F.col("_h")
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h: bigint, i: int>>")
    second = second.select("*", F.when(F.size(h) > F.size(F.array_distinct(h)), placed).otherwise(none).alias("_s")).drop("_h")
    s = F.col("_s")
    third = second.select("*", F.filter(s, _has_twin(s, lambda x: x["h"])).alias("_c")).drop("_s")

    def window(x: Column) -> Column:
        i = x["i"]
        return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))

    fourth = third.select("*", F.array_sort(F.transform("_c", window)).alias("_d")).drop("_c", "_w")
    d = F.col("_d")
    found = F.filter(d, _has_twin(d, lambda x: x["t"]))
    covered = F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return fourth.select("*", F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words")).drop("_d")


def rule_values(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return stats.withColumns({
        "symbols_per_word": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_lines_share": F.col("n_dup_lines") / lines,
        "mean_word_chars": F.col("word_chars") / n,
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in log space, term by term."""
    step = lambda s, j: F.struct(
        (s["term"] + F.log((n - j + 1) / j.cast("double")) + F.log(F.lit(p / (1 - p)))).alias("term"),
        s["total"].alias("total"),
    )
    add = lambda s: F.struct(
        s["term"].alias("term"),
        (F.greatest(s["total"], s["term"]) + F.log1p(F.exp(-F.abs(s["total"] - s["term"])))).alias("total"),
    )
    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))
    indices = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(indices, start, lambda s, j: add(step(s, j)), lambda s: F.exp(s["total"]))


def certified_cutoffs(values: DataFrame, labels: DataFrame, *, stratum: str, key: str = "doc_id",
                      alpha: float = 0.05, delta: float = 0.05, good_cost: float = 20.0) -> DataFrame:
    """One row per stratum, a nullable cutoff column ``cut_<rule>`` for each rule.

    ``labels`` has ``key`` and ``quality`` (1 good, 0 bad).
    """
    known = (labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col(key).alias("_k")).agg((F.max("quality") >= 1).alias("_good")))
    held = (values.where(~F.col("base_failed"))
            .select(F.col(key).alias("_k"), F.coalesce(F.col(stratum).cast("string"), F.lit("\u0000")).alias("_stratum"), *RULES)
            .join(known, "_k"))
    counts = [F.sum(F.col("_good").cast("long")).alias("n_good"), F.sum((~F.col("_good")).cast("long")).alias("n_bad")]
    cells = []
    for rule, grid in RULES.items():
        for i, c in enumerate(grid):
            over = F.col(rule) > c
            counts += [F.sum((over & F.col("_good")).cast("long")).alias(f"{rule}_{i}_k"),
                       F.sum((over & ~F.col("_good")).cast("long")).alias(f"{rule}_{i}_b")]
            cells.append(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"),
                                  F.col(f"{rule}_{i}_k").alias("k"), F.col(f"{rule}_{i}_b").alias("bad")))
    # The strata are few and the counts are narrow: written once, their number is known below.
    summed = materialize(held.groupBy("_stratum").agg(*counts), "strata")
    level = alpha / len(RULES)
    tests = summed.withColumn("_strata", F.lit(max(summed.count(), 1)))
    grid = tests.select("_stratum", "_strata", "n_good", "n_bad", F.explode(F.array(*cells)).alias("c")).select(
        "_stratum", "_strata", "n_good", "n_bad", "c.*")
    # At k >= n * level the tail is about a half or more, so it cannot pass.
    tail = F.when(F.col("k") < F.col("n_good") * level, binomial_tail(F.col("k"), F.col("n_good"), level)).otherwise(F.lit(1.0))
    passed = grid.withColumn("_pass", tail <= F.lit(delta) / (F.lit(len(RULES)) * F.col("_strata")))
    # k never falls along a grid, so the passing cutoffs are those before the first failure.
    gain = F.col("bad") / F.greatest("n_bad", F.lit(1)) - F.lit(good_cost) * F.col("k") / F.greatest("n_good", F.lit(1))
    useful = passed.where(F.col("_pass") & (gain > 0))
    return (useful.groupBy("_stratum").pivot("rule", list(RULES))
            .agg(F.max(F.struct(gain.alias("g"), (-F.col("i")).alias("o"), F.col("cutoff").alias("cutoff")))["cutoff"])
            .select("_stratum", *(F.col(r).alias(f"cut_{r}") for r in RULES)))


def apply_rules(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", key: str = "doc_id", text: str = "text",
                alpha: float = 0.05, delta: float = 0.05, good_cost: float = 20.0) -> DataFrame:
    """The statistics of every document, ``base_failed``, the cutoffs and ``kept``.

    Keeps the columns of ``docs`` other than the text.
    """
    taken = [c for c in docs.columns if c in (key, stratum)]
    stats = materialize(rule_values(text_statistics(docs.select(*dict.fromkeys([*taken, text])), text).drop(text)), "rules")
    cuts = materialize(certified_cutoffs(stats, labels, stratum=stratum, key=key, alpha=alpha, delta=delta,
                                          good_cost=good_cost), "cutoffs")
    joined = stats.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("\u0000"))).join(cuts, "_stratum", "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "n_lines")

"""Quality rules with risk-controlled thresholds, in built-in functions only.

Fixed rules reject texts with too few words or too many repeated words. The other cut-offs are
learnt: for every stratum and feature the strictest threshold of a grid is taken for which an exact
(Clopper-Pearson) upper bound on the share of good labelled documents that it would reject is at
most that feature's part of ``alpha``. Stricter thresholds reject no fewer documents, so a grid is
tested in a fixed sequence from its lenient end and stops at the first failure, which needs no
correction inside the grid; the error ``delta`` is shared out evenly over the (stratum, feature)
sequences (Bonferroni), and the parts of ``alpha`` add up over features. So all bounds hold together
with probability 1 - ``delta``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import durable, refuse, valid_text

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Features that reject when at or above a threshold, and the grids of thresholds.
GRIDS: dict[str, list[float]] = {
    "symbol_ratio": [0.01 * 1.25**k for k in range(24)],
    "dup_line_ratio": [0.02 * 1.2**k for k in range(22)],
    "repeat_ratio": [0.02 * 1.16**k for k in range(22)],
    "word_chars_high": [5.0 + 0.25 * k for k in range(40)],
    "word_chars_low": [-4.5 + 0.125 * k for k in range(24)],
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once. ``body`` must take one argument only: a second would get the index."""
    return F.transform(F.array(value), body)[0]


def tail(values: Column, n: int) -> Column:
    """An array without its first ``n`` elements."""
    return F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))


def head(values: Column, n: int) -> Column:
    """An array without its last ``n`` elements."""
    return F.slice(values, 1, F.greatest(F.size(values) - n, F.lit(0)))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of eight words, from hashes of one, two and four words."""

    def joined(step: int):
        return lambda h: F.zip_with(head(h, step), tail(h, step), lambda a, b: F.xxhash64(a, b))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = let(hashes, joined(step))
    return hashes


def covered_words(hashes: Column, size: int = 8) -> Column:
    """Words inside windows whose hash occurs twice or more in the array of window hashes."""

    def count(h: Column) -> Column:
        placed = F.array_sort(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, positions)

    def positions(s: Column) -> Column:
        same = F.zip_with(s, tail(s, 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        twice = let(same, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), head(e, 1)), lambda x, y: x | y))
        kept = F.filter(F.zip_with(s, twice, lambda a, t: F.when(t, a["i"])), lambda i: i.isNotNull())
        return let(F.array_sort(kept), cover)

    def cover(p: Column) -> Column:
        gaps = F.zip_with(p, tail(p, 1), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), count(hashes)).otherwise(F.lit(0))


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns plus the counts of the quality rules for every row of ``docs``.

    Null and empty texts count 0 everywhere. Texts are taken whole; repeated rows count alike. Bytes that
    aren't UTF-8 are read as U+FFFD. Carried columns may not bear a count's name (ValueError).
    """
    refuse(carry, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])
    text = F.coalesce(valid_text(F.col("text")), F.lit(""))
    rows = docs.select(*carry, text.alias("__text"))
    words = F.filter(F.split("__text", BLANK), lambda w: w != "")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.when(F.size(w) >= 9, let(window_hashes(w), lambda h: covered_words(h))).otherwise(F.lit(0)).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    rows = rows.select(
        *carry,
        counts.alias("__w"),
        of_lines.alias("__l"),
        F.length(F.regexp_replace("__text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return rows.select(
        *carry,
        F.col("__w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("__l.d").cast("long").alias("n_dup_lines"),
        F.col("__w.r").cast("long").alias("n_repeat_words"),
        F.col("__l.n").cast("long").alias("n_lines"),
    )


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """The fixed rules over the counts."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def feature_columns() -> dict[str, Column]:
    """The features that thresholds are learnt for."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_chars_high": F.col("word_chars") / words,
        "word_chars_low": -F.col("word_chars") / words,
    }


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series at x + 8 (error below 1e-12)."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + float(i))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_binomial_cdf(k: Column, n: Column, p: float, terms: int = 2000) -> Column:
    """ln P(X <= k) for X binomial(n, p) and k below n p.

    Terms are summed from k downwards, each from its neighbour, in units of the first one. They shrink
    ever faster, so what is left after ``terms`` of them is at most a geometric series, which is added:
    the result is exact for k < ``terms`` and else no less than the exact value, at a fixed cost.
    """
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        j = k - i  # from j + 1 to j
        term = F.when((j < 0) | (acc["term"] < 1e-30), 0.0).otherwise(acc["term"] * (j + 1) / (n - j) * odds)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    done = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(k, F.lit(1.0)), F.lit(float(terms))).cast("int")), start, step)
    ratio = F.greatest(k - terms, F.lit(0.0)) / (n - k + terms + 1) * odds
    return first + F.log(done["sum"] + done["term"] * ratio / (1 - ratio))


def rejections(measured: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """(stratum, feature, total, k, threshold, rejected): good labelled documents that each threshold of each grid rejects.

    Only rows that pass the fixed rules are at risk. One aggregation to at most (grid + 1) counts a
    stratum and feature; nothing else is gathered.
    """
    good = labels.where("quality = 1").select("doc_id").dropDuplicates()
    cells = [
        F.struct(F.lit(name).alias("feature"), F.array(*[F.lit(float(t)) for t in GRIDS[name]]).alias("grid"), value.cast("double").alias("value"))
        for name, value in feature_columns().items()
    ]
    rows = measured.where(~base_failed()).join(good, "doc_id").select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.explode(F.array(*cells)).alias("c"))
    # how many thresholds of the grid reject the row
    level = F.aggregate("c.grid", F.lit(0), lambda acc, t: acc + F.when(F.col("c.value") >= t, 1).otherwise(0))
    counts = rows.select("stratum", "c.feature", "c.grid", level.alias("level")).groupBy("stratum", "feature", "grid", "level").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("stratum", "feature", "grid").agg(F.collect_list(F.struct("level", "n")).alias("levels"), F.sum("n").alias("total"))
    tried = per.select("stratum", "feature", "total", "levels", F.posexplode("grid").alias("k", "threshold"))
    rejected = F.aggregate("levels", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["level"] > F.col("k"), x["n"]).otherwise(F.lit(0)))
    return tried.select("stratum", "feature", "total", "k", "threshold", rejected.alias("rejected"))


def learn_thresholds(measured: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """(stratum, feature, threshold) where a threshold passes, from all good labels; any number of strata.

    ``measured`` has doc_id, the stratum column and the counts; ``labels`` has doc_id and quality.
    """
    tried = durable(rejections(measured, labels, stratum), "rejections")
    strata = tried.select("stratum").distinct().count()
    share, error = alpha / len(GRIDS), delta / (max(1, strata) * len(GRIDS))
    # more rejections than share * n can't pass, and need no sum
    passed = (F.col("rejected") < share * F.col("total")) & (log_binomial_cdf(F.least(F.col("rejected"), F.floor(share * F.col("total"))), F.col("total"), share) <= math.log(error))
    tested = tried.select("stratum", "feature", "k", "threshold", passed.alias("passed"))
    # the sequence runs down from the largest k; what lies below its first failure isn't tested
    stop = tested.where(~F.col("passed")).groupBy("stratum", "feature").agg(F.max("k").alias("stop"))
    after = tested.join(stop, ["stratum", "feature"], "left").where(F.col("k") > F.coalesce("stop", F.lit(-1)))
    return after.groupBy("stratum", "feature").agg(F.min("threshold").alias("threshold"))


def apply_rules(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``, by thresholds learnt from ``measured`` itself; see :func:`judge`."""
    return judge(measured, learn_thresholds(measured, labels, stratum, alpha, delta), stratum)


def judge(measured: DataFrame, thresholds: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``, by :func:`learn_thresholds`' rows.

    Strata without enough labels get no learnt thresholds, so only the fixed rules hold there; a null
    stratum is one of its own. With no labels at all only the fixed rules hold. Labels of unknown or
    null doc_ids are ignored. Thresholds are joined by stratum, one row each.
    """
    values = feature_columns()
    learnt = thresholds.groupBy("stratum").agg(*[F.max(F.when(F.col("feature") == name, F.col("threshold"))).alias(f"__t_{name}") for name in values])
    names = measured.columns
    judged = measured.withColumn("__stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(learnt.withColumnRenamed("stratum", "__stratum"), "__stratum", "left")
    verdict = ~base_failed()
    for name, value in values.items():
        verdict = verdict & F.coalesce(value < F.col(f"__t_{name}"), F.lit(True))
    return judged.select(*names, base_failed().alias("base_failed"), verdict.alias("kept"))

"""Quality rules as a learned decision list, with built-in functions only.

``features`` computes every statistic of a document inside Spark expressions.  ``learn``
runs sequential covering: a rule is grown condition by condition (the threshold with the
best information gain, from one grouped count over binned features), pruned on rows held
back from growing, and the rows it covers are set aside before the next rule.  ``verdict``
turns the list into one ordered conditional expression.

The list is fitted on at most about ``FIT_ROWS`` labelled rows, taken by a hash of the id;
everything else covers all documents and whole texts.

Defined results: a null text has no words and fails the base rules; repeated rows are
judged alike, each for itself; rows without a label, or with a null one, do not train;
without usable labels the list is empty and only the base rules judge; an empty table
gives no rows; other columns of the table are not read.  Two different 3-word windows
count as one if their 64-bit hashes agree within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, read, sampled, words_of

FIT_ROWS = 20_000
QUANTILES = 16
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_PRECISION = 0.8
#: Numbers that conditions may test, from the columns of ``features``.
TESTED = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "line_words")
Condition = tuple[str, str, float]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and the columns of ``TESTED``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    out = docs.select("doc_id", text.alias("t"))
    out = out.withColumns({
        "w": words_of(F.col("t")),
        "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": without(r"[#*$%&|<>]+").cast("long"),
        "n_upper": without("[A-Z]+"),
        "n_marks": without("[!?]+"),
    })
    out = out.withColumns({"n_words": F.size("w").cast("long"), "n_lines": F.size("lines")})
    out = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_lines",
        (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("IF(n_words < 3, array(), transform(sequence(0, CAST(n_words AS INT) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("h"),
    )
    out = out.withColumn("h", F.expr("IF(size(array_distinct(h)) = size(h), array(), h)"))
    out = out.withColumn("s", F.expr("sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))")).drop("h")
    # places of windows that occur again, in order
    out = out.withColumn("p", F.expr(
        "sort_array(transform(filter(sequence(0, size(s)), k -> k < size(s) AND"
        " ((k > 0 AND s[k].h = s[k - 1].h) OR (k + 1 < size(s) AND s[k].h = s[k + 1].h))), k -> s[k].i))"
    )).drop("s")
    out = out.withColumn("n_repeat_words", F.expr(
        "IF(size(p) = 0, 0L, 3L + aggregate(sequence(0, size(p)), 0L,"
        " (a, k) -> a + IF(k + 1 < size(p), least(3, p[k + 1] - p[k]), 0)))"
    )).drop("p")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("mean_chars"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "word_chars").alias("mark_share"),
        share("n_words", "n_lines").alias("line_words"),
    )


def _holds(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for name, way, at in rule:
        out = out & ((F.col(name) > at) if way == ">" else (F.col(name) <= at))
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: false where a rule holds, else true."""
    out = None
    for rule in rules:
        out = F.when(_holds(rule), F.lit(False)) if out is None else out.when(_holds(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """For each tested column the (bad, good) rows of each bin; bin k lies above k of the thresholds."""
    bins = [
        F.struct(F.lit(name).alias("f"), sum((F.when(F.col(name) > t, 1).otherwise(0) for t in at), F.lit(0)).alias("b"))
        for name, at in cuts.items() if at
    ]
    out = {name: [(0, 0)] * (len(at) + 1) for name, at in cuts.items()}
    if bins:
        found = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(
            F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n"))
        for r in found.collect():  # at most columns x (QUANTILES + 1) rows
            out[r.f][r.b] = (r.p, r.n)
    return out


def _best(counts: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None, tuple[int, int]]:
    """The condition with the largest information gain for bad rows."""
    best: tuple[float, Condition | None, tuple[int, int]] = (0.0, None, (0, 0))
    for name, bins in counts.items():
        p, n = (sum(x) for x in zip(*bins, strict=True))
        if not p:
            continue
        low_p = low_n = 0
        for (a, b), at in zip(bins, cuts[name], strict=False):
            low_p, low_n = low_p + a, low_n + b
            for way, x, y in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
                if x:
                    gain = x * (math.log2(x / (x + y)) - math.log2(p / (p + n)))
                    tied = best[1] is not None and abs(gain - best[0]) <= 1e-9 and best[1][:2] == (name, way)
                    # of equal thresholds on one column, the one that reaches furthest from the good rows
                    if gain > best[0] + 1e-9 or (tied and way == ">"):
                        best = (gain, (name, way, at), (x, y))
    return best


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """Rules for bad rows, in order, from rows with the columns of ``TESTED``, ``bad`` and ``grow``."""
    quantiles = [i / QUANTILES for i in range(QUANTILES + 1)]
    bad = labelled.where("bad")
    rules: list[list[Condition]] = []

    def thresholds(rows: DataFrame) -> dict[str, list[float]]:
        r = rows.agg(*(F.percentile_approx(name, quantiles, 1000).alias(name) for name in TESTED)).first()
        return {name: {float(x) for x in r[name] or ()} for name in TESTED}

    of_all, of_bad = thresholds(labelled), thresholds(bad)
    cuts = {}
    for name in TESTED:
        at = sorted(of_all[name] | of_bad[name] | {0.0})
        cuts[name] = sorted({*at, *((a + b) / 2 for a, b in zip(at, at[1:], strict=False))})
    left = labelled
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            _, condition, (p, n) = _best(_counts(left.where(F.col("grow") & _holds(rule)), cuts), cuts)
            if condition is None:
                break
            rule.append(condition)
            if not n:
                break
        if not rule:
            break
        # prune: the shortest head of the rule with the best margin on the rows held back
        r = left.where(~F.col("grow")).agg(*(
            F.sum((_holds(rule[:k]) & (F.col("bad") == is_bad)).cast("long")).alias(f"{name}{k}")
            for k in range(1, len(rule) + 1) for name, is_bad in (("p", True), ("n", False))
        )).first()
        score = {k: ((r[f"p{k}"] or 0) + 1) / ((r[f"p{k}"] or 0) + (r[f"n{k}"] or 0) + 2) for k in range(1, len(rule) + 1)}
        size = max(score, key=lambda k: (score[k], -k))
        covered = (r[f"p{size}"] or 0) + (r[f"n{size}"] or 0)
        if not covered or (r[f"p{size}"] or 0) < MIN_PRECISION * covered:
            break
        rules.append(rule[:size])
        left = left.where(~_holds(rule[:size]))
    return rules


def training_rows(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    chosen = labels.where(sampled(fit_rows / max(1, labels.count()), "fit"))
    return cut(stats.where("NOT base_failed").join(chosen, "doc_id").select(
        *TESTED, "bad", (F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) > 0).alias("grow")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``features`` with kept: false if base_failed, else the learned list's verdict."""
    stats = cut(features(docs))
    rules = learn(training_rows(stats, labels))
    return stats.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

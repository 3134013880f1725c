"""Evaluation metrics as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import normalize_answer
from textloom.operators.mixing import running_total


def auroc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUROC with ties counted half; null if a class is missing.

    Rows are first counted by score, so the ordered window runs over distinct scores only.
    """
    by = scored.groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by.withColumn("won", F.col("pos") * (below + 0.5 * F.col("neg")))
    return won.agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def calibration_error(scored: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over right-closed equal-width bins, the first closed both ways."""
    at = F.greatest(F.ceil(F.col(confidence) * bins) - 1, F.lit(0))
    by = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 per group; undefined rates are null."""
    count = lambda c: F.count_if(c)
    got = df.groupBy(*by).agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & actual).alias("fn"), count(~predicted & ~actual).alias("tn"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return got.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")}).withColumn("f1", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def quantiles(df: DataFrame, value: str, at: list[float], together: int = 100_000) -> list[float | None]:
    """Exact quantiles with linear interpolation between order statistics, by narrowing ranges; nulls don't count.

    Each wanted rank is sought in a range of values that holds it: a pass counts the values of the range in 64 cuts of approximate
    quantiles, until few enough are left to be sorted. No task ever sorts the column.
    """
    col = F.col(value).cast("double")
    n, low, high = df.agg(F.count(col), F.min(col), F.max(col)).first()
    if not n:
        return [None] * len(at)

    def kth(k: int) -> float:
        a, b, below, inside = low, high, 0, n  # values in [a, b]; ``below`` are under a
        while inside > together and a < b:
            part = df.where((col >= a) & (col <= b))
            cuts = sorted({a, b, *part.agg(F.percentile_approx(col, [i / 64 for i in range(1, 64)], 1000)).first()[0]})
            counts = part.agg(*(F.count_if(col < c).alias(f"l{i}") for i, c in enumerate(cuts)), *(F.count_if(col <= c).alias(f"e{i}") for i, c in enumerate(cuts))).first()
            at_cut = next(((c, counts[f"l{i}"]) for i, c in enumerate(cuts) if below + counts[f"l{i}"] <= k < below + counts[f"e{i}"]), None)
            if at_cut:
                return at_cut[0]
            i = max(i for i in range(len(cuts)) if below + counts[f"e{i}"] <= k)
            # strictly between two cuts: the next values stand in for open ends
            ends = part.where((col > cuts[i]) & (col < cuts[i + 1])).agg(F.min(col), F.max(col), F.count(col)).first()
            below, a, b, inside = below + counts[f"e{i}"], *ends
        return df.where((col >= a) & (col <= b)).select(col.alias("v")).orderBy("v").limit(k - below + 1).agg(F.max("v")).first()[0]

    ranks = {k: kth(k) for k in sorted({int(f(q * (n - 1))) for q in at for f in (math.floor, math.ceil)})}
    found = []
    for q in at:
        x = q * (n - 1)
        lower, upper = ranks[math.floor(x)], ranks[math.ceil(x)]
        found.append(lower + (upper - lower) * (x - math.floor(x)))
    return found


def threshold_sweep(scored: DataFrame, score: str, label: str, at: list[float]) -> DataFrame:
    """Rates at score quantiles: one pass over conditional counts, an operating point each."""
    cuts = quantiles(scored, score, at)
    hit = lambda c: F.col(score) >= F.lit(c)
    points = [F.struct(F.lit(i).alias("point"), F.lit(c).cast("double").alias("threshold"), F.count_if(hit(c) & (F.col(label) == 1)).alias("tp"), F.count_if(hit(c) & (F.col(label) == 0)).alias("fp"), F.count_if(~hit(c) & (F.col(label) == 1)).alias("fn")) for i, c in enumerate(cuts)]
    return scored.agg(F.array(*points).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def cluster_mean_se(df: DataFrame, value: str, cluster: str) -> DataFrame:
    """Mean and its cluster-robust standard error sqrt(G / (G - 1) * sum (S_c - m n_c)^2) / N."""
    by = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    total = by.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.count("*").alias("g"))
    m = F.col("ts") / F.col("tn")
    got = by.crossJoin(F.broadcast(total)).groupBy("ts", "tn", "g").agg(F.sum(F.pow(F.col("s") - m * F.col("n"), 2)).alias("q"))
    return got.select(m.alias("mean"), (F.sqrt(F.col("g") / F.nullif(F.col("g") - 1, F.lit(0)) * F.col("q")) / F.col("tn")).alias("se"), F.col("tn").alias("n"), F.col("g").alias("clusters"))


def paired_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """McNemar-style counts of two hit columns, the difference of their rates, its paired standard error and z (0 without spread)."""
    got = df.agg(F.count_if(F.col(a) & ~F.col(b)).alias("a_only"), F.count_if(~F.col(a) & F.col(b)).alias("b_only"), F.count("*").alias("n"))
    apart, rows = F.col("a_only") - F.col("b_only"), F.greatest("n", F.lit(1))
    sigma = F.sqrt(F.greatest(F.col("a_only") + F.col("b_only") - apart * apart / rows, F.lit(0.0))) / rows
    got = got.withColumns({"diff": apart / rows, "sigma": sigma})
    return got.withColumn("z", F.when(F.col("sigma") > 0, F.col("diff") / F.col("sigma")).otherwise(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the multisets of two token arrays; both empty count as a match."""
    kinds = F.array_intersect(a, b)
    same = F.aggregate(kinds, F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2.0 * same / (F.size(a) + F.size(b)))


def answer_scores(prediction: Column, references: Column) -> Column:
    """(f1, exact) of an answer, normalised, against the best of its references; without references 0 and false."""
    words = lambda t: F.filter(F.split(normalize_answer(t), " "), lambda w: w != "")
    own = words(prediction)
    each = F.transform(references, lambda r: token_f1(own, words(r)))
    return F.struct(F.coalesce(F.array_max(each), F.lit(0.0)).alias("f1"), F.coalesce(F.exists(references, lambda r: normalize_answer(r) == normalize_answer(prediction)), F.lit(False)).alias("exact"))


def equal_count_bins(df: DataFrame, value: str, tie: str, bins: int, name: str = "bin") -> DataFrame:
    """``df`` with bins from 1 of equal count by (value, tie), the first ones taking one row more; as ntile, but no task ranks all rows.

    Rows are numbered over 256 ranges of the value between approximate quantiles; equal values lie in one range.
    """
    n = df.count()
    cuts = df.agg(F.percentile_approx(F.col(value), [i / 256 for i in range(1, 256)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(value))) if cuts else F.lit(0)
    ranked = running_total(df, bucket, [F.col(value), F.col(tie)], F.lit(1), "__k")
    base, extra = divmod(n, bins)
    wide = extra * (base + 1)
    bin_of = F.when(F.col("__k") <= wide, F.floor((F.col("__k") - 1) / (base + 1)) + 1).otherwise(F.floor((F.col("__k") - 1 - wide) / max(base, 1)) + extra + 1)
    return ranked.withColumn(name, bin_of.cast("int")).drop("__k")


def rank_of_gold(scores: Column, gold: Column) -> Column:
    """Rank of element ``gold`` (from 0) among scores, the best 1, ties counted half."""
    own = F.get(scores, gold)
    return 1 + F.size(F.filter(scores, lambda s: s > own)) + 0.5 * (F.size(F.filter(scores, lambda s: s == own)) - 1)


def binomial_sigma(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))


def softmax(x: Column, beta: float) -> Column:
    """softmax(-x / beta) of an array of costs: small beta puts all on the least, large beta spreads evenly."""
    least = F.array_min(x)
    weights = F.transform(x, lambda v: F.exp((least - v) / beta))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, v: s + v))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def first_confident(p: Column, tau: float) -> Column:
    """Index (from 0) of the first value of at least tau, else the last."""
    at = F.array_position(F.transform(p, lambda x: x >= tau), True)
    return F.when(at > 0, at - 1).otherwise(F.size(p) - 1)


def lower_hull(points: DataFrame, at: DataFrame, x: str = "x", y: str = "y", most: int = 1000) -> DataFrame:
    """The lower convex hull of at most ``most`` points, read at the x of ``at``: the least chord over pairs that straddle it.

    The bound is checked, as the chords of all pairs are broadcast.
    """
    if points.limit(most + 1).count() > most:
        raise ValueError(f"a hull of over {most} points")
    a, b = points.select(F.col(x).alias("x0"), F.col(y).alias("y0")), points.select(F.col(x).alias("x1"), F.col(y).alias("y1"))
    spans = at.join(F.broadcast(a.join(b, F.col("x0") <= F.col("x1"))), (F.col("x0") <= F.col(x)) & (F.col(x) <= F.col("x1")))
    chord = F.when(F.col("x0") == F.col("x1"), F.least("y0", "y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(x) - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)))
    return spans.groupBy(x).agg(F.min(chord).alias("hull"))

"""Joins and orders that Spark has no operator for, as compositions of equi-joins, aggregations and bounded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import order_key
from textloom.operators.mixing import grouped_total, running_total


def as_of(points: DataFrame, starts: DataFrame, at: str, start: str, owner: str, width: int) -> DataFrame:
    """``points`` with the ``owner`` of the largest ``start`` that is not over ``at``; null before the first start.

    Both sides are cut into ranges of ``width``. Within a range a window carries the last start on; what a range inherits is the last start
    of the ranges before it, found over one row for each range in two levels. ``start`` is unique; ``width`` bounds a range's rows.
    """
    opened = starts.select(F.floor(F.col(start) / width).alias("__range"), F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(start).alias("s"), F.col(owner).alias("o")).alias("__own"))
    last = opened.groupBy("__range").agg(F.max("__own").alias("__last"))
    row = F.struct(*points.columns)
    asked = points.select(F.floor(F.col(at) / width).alias("__range"), F.col(at).alias("__at"), F.lit(1).alias("__kind"), row.alias("__row"))
    both = opened.unionByName(asked, allowMissingColumns=True)
    inside = Window.partitionBy("__range").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("__here", F.last("__own", ignorenulls=True).over(inside)).where("__kind = 1").select("__range", "__row", "__here")
    known = told.where("__here IS NOT NULL").select("__row.*", F.col("__here.o").alias(owner))
    # what a range inherits: the last start of the ranges before it, over blocks of 4096 ranges and then inside a block
    lost = told.where("__here IS NULL").drop("__here")
    ranges = last.unionByName(lost.select("__range").distinct(), allowMissingColumns=True).groupBy("__range").agg(F.max("__last").alias("__last")).withColumn("__block", F.floor(F.col("__range") / 4096))
    heads = ranges.groupBy("__block").agg(F.max("__last").alias("__ends"))
    earlier = heads.select("__block", F.last("__ends", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__ends"))
    before = Window.partitionBy("__block").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranges.withColumn("__in", F.last("__last", ignorenulls=True).over(before)).join(earlier, "__block")
    carried = inner.select("__range", F.coalesce("__in", "__ends").alias("__before"))
    return known.unionByName(lost.join(carried, "__range").select("__row.*", F.col("__before.o").alias(owner)))


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of rows with the same ``key`` whose half-open intervals overlap: a_start < b_end and b_start < a_end.

    ``a`` has the columns key, a_start and a_end, ``b`` key, b_start and b_end, all integers, and others with names of their own. Intervals
    meet in the ranges of ``width`` that they touch, and a pair is kept in the first range that both touch, so none comes twice. Empty
    intervals overlap nothing.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        first, last = F.floor(F.col(f"{side}_start") / width), F.floor((F.col(f"{side}_end") - 1) / width)
        return df.where(F.col(f"{side}_end") > F.col(f"{side}_start")).withColumn("__cell", F.explode(F.sequence(first, last)))

    met = dealt(a, "a").join(dealt(b, "b"), [key, "__cell"])
    shared = F.greatest(F.floor(F.col("a_start") / width), F.floor(F.col("b_start") / width)) == F.col("__cell")
    return met.where(shared & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))).drop("__cell")


def runs(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, run, value, n): consecutive rows of a group with one value, by gaps and islands."""
    by = Window.partitionBy(group).orderBy(*order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(by)) | F.lag(F.lit(1)).over(by).isNull()).cast("int")
    marked = df.withColumn("__new", starts).withColumn("run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def renumbered(df: DataFrame, removed: DataFrame, key: str, width: int, name: str = "new_id") -> DataFrame:
    """``df`` without the removed ids, and dense numbers from 0 in the order of the id; two-level, so no task ranks all rows."""
    left = df.join(removed.select(key).distinct(), key, "left_anti")
    return running_total(left, F.floor(F.col(key) / width), [F.col(key)], F.lit(1), name).withColumn(name, F.col(name) - 1)


def epoch_order(df: DataFrame, key: str, head: Column, seed: int, name: str = "position") -> DataFrame:
    """Positions from 1 of a seeded permutation that plays the rows of ``head`` first; two-level over 512 ranges of the hash."""
    shuffled = order_key(seed, F.col(key))
    bucket = F.when(head, 0).otherwise(256) + F.conv(F.substring(shuffled, 1, 2), 16, 10).cast("int")
    return running_total(df, bucket, [shuffled, F.col(key)], F.lit(1), name)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only ``a`` and only ``b`` have, repeats counted; both 0 means equal as multisets."""
    only_a, only_b = a.exceptAll(b).select(F.lit(1).alias("a"), F.lit(0).alias("b")), b.exceptAll(a).select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    return only_a.unionByName(only_b).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("only_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("only_b"))


def first_divergence(a: Column, b: Column) -> Column:
    """First index from 0 at which two arrays differ; 0 where no index within the shorter one separates them."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when((at > 0) & (at <= F.least(F.size(a), F.size(b))), at - 1).otherwise(F.lit(0).cast("long"))


def choices(options: DataFrame, item: str, logprob: str, chars: str, gold: str, place: str) -> DataFrame:
    """(item, by_sum, by_length, n): whether the option of the best sum, and of the best mean per character, is the gold one.

    Ties go to the smaller place. ``gold`` marks the right option; an item needs no list of its options, only two maxima.
    """
    best = lambda score: F.max_by(gold, F.struct(score, -F.col(place)))
    return options.groupBy(item).agg(best(F.col(logprob)).alias("by_sum"), best(F.col(logprob) / F.col(chars)).alias("by_length"), F.count("*").alias("n"))


def tie_expectation(options: DataFrame, item: str, score: str, gold: str) -> DataFrame:
    """(item, expected): the chance that a picker of the highest score, ties at random, picks a gold option."""
    by = options.groupBy(item, score).agg(F.count("*").alias("ties"), F.sum(F.col(gold).cast("int")).alias("right"))
    return by.groupBy(item).agg(F.max_by(F.col("right") / F.col("ties"), score).alias("expected"))


def demand(files: DataFrame, source: str, file: str, tokens: str, target: Column, margin: float) -> DataFrame:
    """(source, files, tokens): the files of each source, in order, that reach its target times the margin; the crossing one included."""
    by = Window.partitionBy(source).orderBy(file)
    summed = files.withColumn("__target", target).withColumn("__before", F.coalesce(F.sum(tokens).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return summed.where(F.col("__before") < F.col("__target") * margin).groupBy(source).agg(F.count("*").alias("files"), F.sum(tokens).alias("tokens"))


def prior_delta(results: DataFrame, suffix: str, name: str) -> DataFrame:
    """(id, tier, name): the rank of an item's control, its id and the suffix, less its own; items without a control are left out."""
    control = results.where(F.endswith("id", F.lit(suffix))).select(F.expr(f"substring(id, 1, length(id) - {len(suffix)})").alias("id"), F.col("rank").alias("__prior"))
    real = results.where(~F.endswith("id", F.lit(suffix)))
    return real.join(control, "id").select("id", "tier", (F.col("__prior") - F.col("rank")).alias(name))


def compared(scores: DataFrame, chance: dict[str, float]) -> DataFrame:
    """(task, model, score, headroom, best, mean): each score against its task's chance level, the best of a task, a model's mean headroom."""
    level = F.create_map(*[F.lit(x) for pair in chance.items() for x in pair])[F.col("task")]
    room = scores.withColumn("headroom", (F.col("score") - level) / (1 - level))
    # windows over one reading of the scores: a second one may add up an average in another order, and no score then equals the best
    top, mean = F.max("score").over(Window.partitionBy("task")), F.avg("headroom").over(Window.partitionBy("model"))
    return room.select("task", "model", "score", "headroom", (F.col("score") == top).alias("best"), mean.alias("mean"))


def consumption_order(files: DataFrame) -> DataFrame:
    """``files`` (source, file, phase) in the order they are used: by phase, then by the part of the source's files of the phase, then source."""
    own = files.withColumn("__slice", F.concat_ws(":", "source", "phase"))
    ranked = grouped_total(own, "__slice", F.floor(F.col("file") / 4096), [F.col("file")], F.lit(1), "__k")
    sizes = own.groupBy("__slice").agg(F.count("*").alias("__n"))
    keyed = ranked.join(F.broadcast(sizes), "__slice").withColumn("fraction", F.col("__k") / F.col("__n"))  # a row for each slice
    placed = running_total(keyed, F.col("phase") * 2048 + F.floor(F.col("fraction") * 1024), [F.col("fraction"), F.col("source"), F.col("file")], F.lit(1), "position")
    return placed.drop("__slice", "__k", "__n")


def backfilled(old: DataFrame, rebuilt: DataFrame, key: str, column: str) -> DataFrame:
    """``old`` with one column of a rebuilt table; every other column must be equal in both, row by row of the key, or it is an error."""
    same = difference(old, rebuilt.select(*old.columns)).first()
    if same.only_a or same.only_b:
        raise ValueError(f"{same.only_a} old and {same.only_b} rebuilt rows differ")
    return old.join(rebuilt.select(key, column), key)


def normalised_shares(text: Column) -> Column:
    """The map of ``a:1,b:3`` with shares that sum to 1; null if one isn't positive."""
    pairs = F.str_to_map(text, F.lit(","), F.lit(":"))
    values = F.transform_values(pairs, lambda _, v: v.try_cast("double"))
    total = F.aggregate(F.map_values(values), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.forall(F.map_values(values), lambda v: F.coalesce(v > 0, F.lit(False))), F.transform_values(values, lambda _, v: v / total))


def slice_argument(text: Column) -> Column:
    """(label, path, share, passes) of ``label=path:share[:passes]``, passes 1 unless given; null for anything else."""
    pattern = r"^([^=]+)=(.+?):(\d+(?:\.\d+)?)(?::(\d+))?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("label"), part(2).alias("path"), part(3).cast("double").alias("share"), F.coalesce(part(4).try_cast("long"), F.lit(1).cast("long")).alias("passes")))

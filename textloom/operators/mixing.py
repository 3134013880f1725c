"""Mixing, sampling, splitting and merging of sources under token budgets.

Global running sums take two levels: totals of buckets of the order key, summed over the few bucket rows, and a running sum inside each
bucket. No task ever holds the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import draw, order_key


def running_total(df: DataFrame, bucket: Column, order: list[Column], value: Column, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and including this one, in the order of (bucket, order).

    ``bucket`` must be monotone in the wanted order and have few distinct values (thousands), which are summed in one small window.
    """
    marked = df.withColumn("__bucket", bucket).withColumn("__value", value)
    totals = marked.groupBy("__bucket").agg(F.sum("__value").alias("__total"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(offsets, "__bucket").withColumn(name, F.col("__before") + F.sum("__value").over(inside)).drop("__bucket", "__value", "__before")


def cut(df: DataFrame, running: str, value: str, target: int, inclusive: bool) -> DataFrame:
    """Rows up to the token target; the row that crosses it stays only if ``inclusive``."""
    return df.where(F.col(running) - F.col(value) < target) if inclusive else df.where(F.col(running) <= target)


def grouped_total(df: DataFrame, group: str, bucket: Column, order: list[Column], value: Column, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` within its group up to and including each row, in the order of (bucket, order).

    Two levels as in ``running_total``: a group, however large, is summed over its buckets' rows, and each bucket inside itself.
    """
    marked = df.withColumn("__bucket", bucket).withColumn("__value", value)
    totals = marked.groupBy(group, "__bucket").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(offsets, [group, "__bucket"]).withColumn(name, F.col("__before") + F.sum("__value").over(inside)).drop("__bucket", "__value", "__before")


def hash_bucket(key: Column) -> Column:
    """One of 4096 buckets of a hexadecimal hash, in its order."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("long")


def weighted_mix(docs: DataFrame, weights: dict[str, float], target: int, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """Documents of a weighted interleave up to ``target`` tokens, crossing one included.

    Each source is shuffled by a seeded hash; its k-th document gets the virtual deadline (k - 0.5) / weight, and the mix takes documents
    by deadline, then source. ``docs`` has doc_id, source and n_tokens; sources without a positive weight take no part. Deadlines are cut
    into ``buckets`` ranges whatever the size of the corpus.
    """
    live = {s: float(w) for s, w in weights.items() if w > 0}
    weight = F.create_map(*[F.lit(x) for pair in live.items() for x in pair])
    own = docs.where(F.col("source").isin(*live) & (F.col("n_tokens") > 0)).withColumn("__h", order_key(seed, F.col("doc_id")))
    last = own.groupBy("source").agg((F.count("*") / F.max(weight[F.col("source")])).alias("d")).agg(F.max("d")).first()[0] or 1.0
    ranked = grouped_total(own, "source", hash_bucket(F.col("__h")), [F.col("__h"), F.col("doc_id")], F.lit(1), "k").drop("__h")
    keyed = ranked.withColumn("deadline", (F.col("k") - 0.5) / weight[F.col("source")])
    summed = running_total(keyed, F.floor(F.col("deadline") * buckets / last), [F.col("deadline"), F.col("source")], F.col("n_tokens"))
    return cut(summed, "running", "n_tokens", target, inclusive=True)


def proportional_order(docs: DataFrame, group: str = "source", order: str = "doc_id", buckets: int = 1024, width: int = 4096) -> DataFrame:
    """Deterministic interleave: the k-th of n documents of a slice stands at (k - 0.5) / n, ties to the smaller slice; column position.

    ``order`` is an integer column; ranges of ``width`` of its values are the buckets in which a slice is numbered.
    """
    counts = docs.groupBy(group).agg(F.count("*").alias("__n"))
    numbered = grouped_total(docs, group, F.floor(F.col(order) / width), [F.col(order)], F.lit(1), "k")
    keyed = numbered.join(F.broadcast(counts), group).withColumn("share", (F.col("k") - 0.5) / F.col("__n")).drop("__n")  # a row for each slice
    return running_total(keyed, F.floor(F.col("share") * buckets), [F.col("share"), F.col(group)], F.lit(1), "position")


def replay_passes(docs: DataFrame, target: int | Column, max_passes: int, seed: int = 42, group: str = "source", n: str = "n_tokens") -> DataFrame:
    """Documents of up to ``max_passes`` seeded permutations of each slice, stopping before the one that would cross ``target`` tokens.

    ``target`` is a number or a column of ``docs``; documents without tokens take no part. Columns pass and running.
    """
    passes = docs.where(F.col(n) > 0).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(max_passes)))).withColumn("__h", order_key(seed, F.col("pass"), F.col("doc_id")))
    summed = grouped_total(passes, group, F.col("pass") * 4096 + hash_bucket(F.col("__h")), [F.col("__h"), F.col("doc_id")], F.col(n))
    return summed.where(F.col("running") <= target).drop("__h")


def tail_split(docs: DataFrame, held: int, group: str = "source", width: int = 4096) -> DataFrame:
    """Column split: val from the first document boundary at or after (total - held) tokens on, at least one document each way."""
    ends = docs.groupBy(group).agg(F.sum("n_tokens").alias("__total"), F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last"))
    summed = grouped_total(docs, group, F.floor(F.col("doc_id") / width), [F.col("doc_id")], F.col("n_tokens"), "__running").join(F.broadcast(ends), group)  # a row for each slice
    val = (F.col("__running") - F.col("n_tokens") >= F.col("__total") - held) | (F.col("doc_id") == F.col("__last"))
    return summed.withColumn("split", F.when(val & (F.col("doc_id") > F.col("__first")), "val").otherwise("train")).drop("__running", "__total", "__first", "__last")


def filler(windows: DataFrame, key: list[str], n: Column, target: int, available: int, max_passes: int, seed: int = 3) -> DataFrame:
    """(pass, windows, tokens, repeats): windows in a seeded order of each pass until ``target`` tokens are covered, crossing one included.

    ``available`` are the tokens of all windows; repeats are the tokens taken over those of the distinct windows among them.
    """
    passes = windows.withColumn("__n", n).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(max_passes))))
    keyed = passes.withColumn("__h", order_key(seed, F.col("pass"), *(F.col(k) for k in key)))
    summed = running_total(keyed, F.col("pass") * 4096 + hash_bucket(F.col("__h")), [F.col("__h"), *(F.col(k) for k in key)], F.col("__n"))
    by = cut(summed, "running", "__n", target, inclusive=True).groupBy("pass").agg(F.count("*").alias("windows"), F.sum("__n").alias("tokens"))
    whole = by.agg(F.sum("tokens").alias("__all"))
    return by.crossJoin(F.broadcast(whole)).select("pass", "windows", "tokens", F.round(F.col("__all") / F.least("__all", F.lit(available)), 6).alias("repeats"))


def slice_union(docs: DataFrame, seed: int = 42, group: str = "source", n: str = "n_tokens", buckets: int = 1024) -> DataFrame:
    """A random interleave that takes from slices in proportion to their tokens; columns place and position.

    The documents of a slice keep their order by doc_id; one whose tokens lie from a to b of the slice's total stands at a drawn point
    between a / total and b / total, so every part of the result holds the slices by their shares.
    """
    totals = docs.groupBy(group).agg(F.sum(n).alias("__total"))
    summed = grouped_total(docs, group, F.floor(F.col("doc_id") / 4096), [F.col("doc_id")], F.col(n), "__to").join(F.broadcast(totals), group)  # a row for each slice
    place = (F.col("__to") - F.col(n) * draw(seed, F.col(group), F.col("doc_id"))) / F.col("__total")
    return running_total(summed.withColumn("place", place), F.floor(F.col("place") * buckets), [F.col("place"), F.col(group), F.col("doc_id")], F.lit(1), "position").drop("__to", "__total")


def merge(docs: DataFrame, shares: dict[str, float], target: int, max_passes: int = 1, seed: int = 42, group: str = "source") -> DataFrame:
    """The merged order (position, source, k, doc_id, pass, n_tokens) of slices that each take their share of ``target`` tokens.

    Shares are normalised. A slice takes seeded permutations of its documents, up to ``max_passes``, and stops before the document that
    would cross its target; the taken documents of all slices interleave in proportion.
    """
    total = sum(shares.values())
    goal = F.create_map(*[F.lit(x) for s, w in shares.items() for x in (s, float(int(target * w / total)))])
    taken = replay_passes(docs.where(F.col(group).isin(*shares)).withColumn("__goal", goal[F.col(group)]), F.col("__goal"), max_passes, seed, group).drop("__goal")
    # the running sum orders a slice's documents and is unique, as each takes at least one token
    ordered = proportional_order(taken, group, "running", width=1 << 22)
    return ordered.select("position", group, "k", "doc_id", "pass", "n_tokens")


def order_digest(k: Column, doc_id: Column) -> Column:
    """An aggregate that two orders of the same documents share only if they are equal; summed, so no task reads a whole order."""
    part = F.conv(F.substring(F.sha1(F.concat_ws(":", k.cast("string"), doc_id.cast("string")).cast("binary")), 1, 8), 16, 10)
    return F.sum(part.cast("decimal(20,0)")).cast("string")


def merge_report(merged: DataFrame, docs: DataFrame, shares: dict[str, float], group: str = "source") -> DataFrame:
    """(source, docs, tokens, share, target_share, passes, digest) of each slice of a merge; passes are tokens over the slice's own."""
    total = sum(shares.values())
    goal = F.create_map(*[F.lit(x) for s, w in shares.items() for x in (s, w / total)])
    own = docs.where(F.col(group).isin(*shares)).groupBy(group).agg(F.sum("n_tokens").alias("__own"))
    by = merged.groupBy(group).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), order_digest(F.col("k"), F.col("doc_id")).alias("digest"))
    whole = by.agg(F.sum("tokens").alias("__all"))
    return by.join(own, group).crossJoin(F.broadcast(whole)).select(group, "docs", "tokens", F.round(F.col("tokens") / F.col("__all"), 6).alias("share"), F.round(goal[F.col(group)], 6).alias("target_share"), F.round(F.col("tokens") / F.col("__own"), 6).alias("passes"), "digest")


def replayed(recorded: DataFrame, docs: DataFrame, group: str = "source") -> DataFrame:
    """A recorded order (position, source, k) over the documents (source, k, ...) of other builds of its slices.

    Every slice must hold exactly the documents that the order takes from it; the first that doesn't is named in the error.
    """
    want, have = recorded.groupBy(group).agg(F.count("*").alias("want")), docs.groupBy(group).agg(F.count("*").alias("have"))
    off = want.join(have, group, "full").where(~F.col("want").eqNullSafe(F.col("have"))).orderBy(group).limit(1).collect()
    if off:
        raise ValueError(f"slice {off[0][group]}: the order takes {off[0].want} documents, the slice holds {off[0].have}")
    return recorded.join(docs, [group, "k"])


def prefix_problems(smaller: DataFrame, larger: DataFrame, columns: list[str], position: str = "position") -> DataFrame:
    """Rows of ``smaller`` that differ from those of the same position of ``larger``, or aren't there; none if it is a prefix."""
    mine, theirs = smaller.select(position, *columns), larger.select(position, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__there"))
    same = F.coalesce(F.col("__there"), F.lit(False))
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return mine.join(theirs, position, "left").where(~same).select(position, *columns)


def shuffle_check(source: DataFrame, shuffled: DataFrame, n: str = "n_tokens", key: str = "doc_id") -> DataFrame:
    """(docs_equal, tokens_equal, missing, extra): whether one table is a permutation of the other, by counts and by keys."""
    each = source.groupBy(key).agg(F.count("*").alias("a"), F.sum(n).alias("at")).join(shuffled.groupBy(key).agg(F.count("*").alias("b"), F.sum(n).alias("bt")), key, "full").fillna(0, ["a", "b", "at", "bt"])
    return each.agg((F.sum("a") == F.sum("b")).alias("docs_equal"), (F.sum("at") == F.sum("bt")).alias("tokens_equal"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))


def exclude_seen(docs: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` isn't among ``seen``; Catalyst broadcasts the keys if they are small."""
    return docs.join(seen.select(key).distinct(), key, "left_anti")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group, by seeded hash; the limit is applied before the shuffle as well."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order_key(seed, F.col(key)), key))).where(F.col("__r") <= n).drop("__r")


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The category whose cumulated weight a uniform number falls under."""
    total, at, found = sum(weights.values()), 0.0, None
    names = list(weights)
    bounds = []
    for name in names[:-1]:
        at += weights[name] / total
        bounds.append((at, name))
    found = F.lit(names[-1])
    for bound, name in reversed(bounds):
        found = F.when(u < bound, name).otherwise(found)
    return found


def cap_chunks(chunks: Column, cap: int) -> Column:
    """All gold chunks, then others in order up to ``cap``, in their old order; chunks are structs with gold."""
    numbered = F.transform(chunks, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    gold = F.filter(numbered, lambda x: x["c"]["gold"])
    rest = F.filter(numbered, lambda x: ~x["c"]["gold"])
    kept = F.concat(gold, F.slice(rest, 1, F.greatest(F.lit(cap) - F.size(gold), F.lit(0))))
    return F.transform(F.array_sort(kept, lambda a, b: a["i"] - b["i"]), lambda x: x["c"])


def first_by_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Exact-text dedup: the smallest key owns a text; columns text hash, key and copies."""
    return docs.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("text_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))

"""Reports over evaluation records, runs and plans: aggregations with small closed forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import draw, let, order_key, sigmoid_ratio
from textloom.operators.metrics import binomial_sigma
from textloom.operators.mixing import hash_bucket, running_total

#: Items that a stratum needs, the most memorisation and the least following that pass, the bar of flips, sigmas that count.
LEAST_ITEMS, MOST_MEMORY, LEAST_FOLLOW, FLIP_BAR, SIGMAS = 30, 0.05, 0.90, 0.90, 3.0


def rate(hit: Column) -> Column:
    """The share of rows for which a condition holds, null over no rows."""
    return F.avg(hit.cast("double"))


def realised(docs: DataFrame, targets: dict[str, int], group: str = "source", n: str = "n_tokens") -> DataFrame:
    """(source, docs, tokens, target, off): tokens of each source against its target, off in signed per cent; sources of no rows have 0."""
    goals = docs.sparkSession.createDataFrame(list(targets.items()), f"{group} string, target long")
    got = docs.groupBy(group).agg(F.count("*").alias("docs"), F.sum(n).alias("tokens"))
    joined = F.broadcast(goals).join(got, group, "left").fillna(0, ["docs", "tokens"])  # a row for each source
    return joined.select(group, "docs", "tokens", "target", (100.0 * (F.col("tokens") - F.col("target")) / F.nullif("target", F.lit(0))).alias("off"))


def supervised_share(docs: DataFrame, group: str, mask: str = "mask") -> DataFrame:
    """(group, supervised, share): supervised tokens of each slice and their share of all."""
    by = docs.groupBy(group).agg(F.sum(F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m)).alias("supervised"))
    whole = by.agg(F.greatest(F.sum("supervised"), F.lit(1)).alias("__all"))
    return by.crossJoin(F.broadcast(whole)).select(group, "supervised", (F.col("supervised") / F.col("__all")).alias("share"))  # one row


def share_problems(shares: DataFrame, targets: dict[str, float], off: float, group: str = "source", share: str = "share") -> DataFrame:
    """(group, share, target) of the slices whose share is more than ``off`` from its target; a missing slice has 0."""
    goals = shares.sparkSession.createDataFrame(list(targets.items()), f"{group} string, target double")
    return goals.join(shares.select(group, share), group, "left").fillna(0.0, [share]).where(F.abs(F.col(share) - F.col("target")) > off)


def task_summary(options: DataFrame) -> DataFrame:
    """(task, n, acc, acc_norm, se, ppl, ppl_doc) of scored options; items that lack one of their options don't count.

    ``options`` has task, item, n_options, place, gold (the place of the right one), logprob, n_bytes, n_tokens. The best option is that
    of the highest log-probability, for acc_norm of the highest per byte, ties to the lower place. ppl is per token of the right options,
    ppl_doc per item; both are cut off where they would overflow.
    """
    best = lambda score: F.max_by("place", F.struct(score, -F.col("place")))
    right = lambda c: F.sum(F.when(F.col("place") == F.col("gold"), F.col(c)))
    by = options.groupBy("task", "item").agg(F.count("*").alias("k"), F.max("n_options").alias("n_options"), F.max("gold").alias("gold"), best(F.col("logprob")).alias("a"), best(F.col("logprob") / F.greatest("n_bytes", F.lit(1))).alias("b"), right("logprob").alias("lp"), right("n_tokens").alias("t"))
    whole = by.where("k = n_options")
    hit = lambda c: (F.col(c) == F.col("gold")).cast("double")
    ce = -F.sum("lp")
    return whole.groupBy("task").agg(
        F.count("*").alias("n"), F.avg(hit("a")).alias("acc"), F.avg(hit("b")).alias("acc_norm"), (F.stddev_samp(hit("a")) / F.sqrt(F.count("*"))).alias("se"),
        F.exp(F.least(ce / F.greatest(F.sum("t"), F.lit(1)), F.lit(20.0))).alias("ppl"), F.exp(F.least(ce / F.count("*"), F.lit(60.0))).alias("ppl_doc"),
    )


def attempts_summary(tries: DataFrame) -> DataFrame:
    """(n, em, se, pass_k): exact match of the first attempt, and the share of items that any attempt solves; has item, attempt, hit."""
    by = tries.groupBy("item").agg(F.max_by(F.col("hit").cast("double"), -F.col("attempt")).alias("first"), F.bool_or("hit").alias("any"))
    return by.agg(F.count("*").alias("n"), F.avg("first").alias("em"), (F.stddev_samp("first") / F.sqrt(F.count("*"))).alias("se"), rate(F.col("any")).alias("pass_k"))


def condition_contrasts(readings: DataFrame) -> DataFrame:
    """(source, none, gold, distractors, ceiling, content, tokens) of (source, condition, ce, tokens), and pooled by tokens as ``all``.

    ceiling is none - gold and content distractors - gold.
    """
    cell = lambda c: F.sum(F.when(F.col("condition") == c, F.col("ce") * F.col("tokens"))) / F.sum(F.when(F.col("condition") == c, F.col("tokens")))
    wide = readings.rollup("source").agg(*(cell(c).alias(c) for c in ("none", "gold", "distractors")), F.sum(F.when(F.col("condition") == "gold", F.col("tokens"))).alias("tokens"))
    return wide.select(F.coalesce("source", F.lit("all")).alias("source"), "none", "gold", "distractors", (F.col("none") - F.col("gold")).alias("ceiling"), (F.col("distractors") - F.col("gold")).alias("content"), "tokens")


def follow_readings(records: DataFrame) -> DataFrame:
    """(items, stratum, n, n_follow, n_stuck, follow_rate, mr_gen, mr_ll, gate) of counterfactual records, over two sets of items.

    ``records`` has stratum, follow, stuck, mr_ll and gold_em. A stratum of under LEAST_ITEMS items is too small for its gate.
    """
    sets = F.explode(F.when(F.col("gold_em") == 1.0, F.array(F.lit("all_eligible"), F.lit("correct_with_gold"))).otherwise(F.array(F.lit("all_eligible"))))
    by = records.withColumn("items", sets).groupingSets([["items", "stratum"], ["items"]], "items", "stratum").agg(F.count("*").alias("n"), F.count_if("follow").alias("n_follow"), F.count_if("stuck").alias("n_stuck"), F.avg(F.when(~F.isnan("mr_ll"), F.col("mr_ll"))).alias("mr_ll"))
    follow, memory = F.col("n_follow") / F.col("n"), F.col("n_stuck") / F.nullif(F.col("n_stuck") + F.col("n_follow"), F.lit(0))
    passed = F.coalesce((memory <= MOST_MEMORY) & (follow >= LEAST_FOLLOW), F.lit(False))
    gate = F.when(F.col("n") < LEAST_ITEMS, "n too small").when(passed, "PASS").otherwise("FAIL")
    return by.select("items", F.coalesce("stratum", F.lit("all")).alias("stratum"), "n", "n_follow", "n_stuck", follow.alias("follow_rate"), memory.alias("mr_gen"), "mr_ll", gate.alias("gate"))


def likelihood_readings(records: DataFrame) -> DataFrame:
    """(stratum, n, mr_ll, prefers_swap) from ll_orig and ll_swap, with a row for all."""
    by = records.rollup("stratum").agg(F.count("*").alias("n"), F.avg(sigmoid_ratio(F.col("ll_orig"), F.col("ll_swap"))).alias("mr_ll"), rate(F.col("ll_swap") > F.col("ll_orig")).alias("prefers_swap"))
    return by.withColumn("stratum", F.coalesce("stratum", F.lit("all")))


def edit_label(kind: Column, follows: Column, stuck: Column, abstains: Column) -> Column:
    """What an answer did after the store changed: follow, stuck, abstained or other."""
    return F.when((kind == "edit") & follows, "follow").when(stuck, "stuck").when((kind == "delete") & abstains, "abstained").otherwise("other")


def flip_rates(labels: DataFrame) -> DataFrame:
    """(kind, n, flip_rate, sigma, pass): an edit flips if it is followed, a delete if the answer isn't stuck."""
    flipped = F.when(F.col("kind") == "edit", F.col("label") == "follow").otherwise(F.col("label") != "stuck")
    by = labels.groupBy("kind").agg(F.count("*").alias("n"), rate(flipped).alias("flip_rate"))
    return by.select("kind", "n", "flip_rate", binomial_sigma(F.col("flip_rate"), F.col("n")).alias("sigma"), (F.col("flip_rate") >= FLIP_BAR).alias("pass"))


def shortcut_pickers(question: Column, answer: Column, relations: Column, facts: Column) -> Column:
    """Expected accuracy of seven pickers that never compose, for one question; ties count by their share.

    ``relations`` are those of the question's chain, ``facts`` an array of (s, r, o). Candidates are the distinct objects of the final
    relation. frequent and infrequent pick by occurrences, named_subject the object of the first fact whose subject the question names,
    final_object among all objects of the final relation, recurring_subject among those whose subject occurs twice or more, penultimate_fed
    among the distinct ones whose subject is an object of the relation before, random among the candidates.
    """
    last = F.element_at(relations, -1)
    before = F.when(F.size(relations) >= 2, F.element_at(F.slice(relations, 1, F.greatest(F.size(relations) - 1, F.lit(1))), -1))
    # each is computed once: as plain columns they would be built anew for every element that a lambda looks at
    told = lambda facts, final, before, question: let(F.filter(facts, lambda f: f["r"] == final), lambda ends: let(F.transform(ends, lambda f: f["o"]), lambda objects: let(F.array_distinct(objects), lambda candidates: let(F.flatten(F.transform(facts, lambda f: F.array(f["s"], f["o"]))), lambda named: _picked(question, answer, facts, before, ends, objects, candidates, named)))))
    return let(facts, lambda fs: let(last, lambda final: let(F.coalesce(before, F.lit("")), lambda own: let(F.lower(question), lambda q: told(fs, final, own, q)))))


def _picked(question: Column, answer: Column, facts: Column, before: Column, ends: Column, objects: Column, candidates: Column, named: Column) -> Column:
    """The pickers' shares from the parts that ``shortcut_pickers`` names; the question in lower case, before the relation before the last."""
    chance = 1.0 / F.size(candidates)
    share = lambda pool: let(pool, lambda p: F.when(F.array_contains(p, answer), 1.0 / F.size(p)).otherwise(0.0))
    count = lambda x: F.size(F.filter(named, lambda n: n == x))
    counted = F.transform(candidates, lambda c: F.struct(c.alias("c"), count(c).alias("n")))
    of = lambda best: let(counted, lambda cs: let(best(F.transform(cs, lambda y: y["n"])), lambda m: share(F.transform(F.filter(cs, lambda x: x["n"] == m), lambda x: x["c"]))))
    subject = F.filter(facts, lambda f: F.array_contains(candidates, f["o"]) & F.contains(question, F.lower(f["s"])))
    recurring = F.transform(F.filter(ends, lambda f: count(f["s"]) > 1), lambda f: f["o"])
    feeders = F.transform(F.filter(facts, lambda f: f["r"] == before), lambda f: f["o"])
    fed = let(feeders, lambda objects: F.array_distinct(F.transform(F.filter(ends, lambda f: F.array_contains(objects, f["s"])), lambda f: f["o"])))
    some = lambda pool: let(pool, lambda p: F.when(F.size(p) > 0, share(p)).otherwise(chance))
    return F.struct(
        of(F.array_max).alias("frequent"), of(F.array_min).alias("infrequent"), let(subject, lambda s: F.when(F.size(s) > 0, (F.get(s, F.lit(0))["o"] == answer).cast("double")).otherwise(chance)).alias("named_subject"), share(objects).alias("final_object"),
        some(recurring).alias("recurring_subject"), some(fed).alias("penultimate_fed"), chance.alias("random"),
    )


def z_against(acc: Column, line: Column, n: Column) -> Column:
    """z of an accuracy against a reference line with the sigma of the line; null without one."""
    return F.when((n > 0) & (line > 0) & (line < 1), (acc - line) / F.sqrt(line * (1 - line) / n))


def validity(cells: DataFrame) -> DataFrame:
    """(valid, readable, failing, unreadable) of grid cells (n, hops, kept, acc, chance).

    A cell that keeps fewer sites than it has hops must be within SIGMAS of chance; the one-hop cells that keep a site must all be that far
    above it, else nothing can be read from the rest.
    """
    null = F.sqrt(F.col("chance") * (1 - F.col("chance")) / F.col("n"))
    read = cells.where("n > 0").withColumns({"fails": (F.col("kept") < F.col("hops")) & (F.abs(F.col("acc") - F.col("chance")) > SIGMAS * null), "first": (F.col("hops") == 1) & (F.col("kept") >= 1)})
    dark = F.col("first") & ~F.coalesce((F.col("acc") - F.col("chance")) / F.nullif(null, F.lit(0.0)) >= SIGMAS, F.lit(False))
    got = read.agg(F.count_if("fails").alias("failing"), F.count_if(dark).alias("unreadable"), F.count_if("first").alias("firsts"))
    readable = (F.col("firsts") > 0) & (F.col("unreadable") == 0)
    return got.select(((F.col("failing") == 0) & readable).alias("valid"), readable.alias("readable"), "failing", "unreadable")


def micro_verdict(deltas: DataFrame) -> DataFrame:
    """(form, verdict) of z values (form, arm, tier, z): whether the arms without memory stay at their prior while the full one climbs."""
    has = lambda arm, tiers, far: F.coalesce(F.bool_or((F.col("arm") == arm) & F.col("tier").isin(*tiers) & far), F.lit(False))
    climbs = has("full", ("100", "1000"), F.col("z") > SIGMAS)
    leaks = has("masked", ("1", "10", "100"), F.abs("z") > SIGMAS) | has("retrieval", ("1", "10", "100"), F.abs("z") > SIGMAS)
    by = deltas.groupBy("form").agg(climbs.alias("climbs"), leaks.alias("leaks"))
    return by.select("form", F.when(~F.col("climbs"), "UNINFORMATIVE").when(~F.col("leaks"), "HOLDS").otherwise("FAILS").alias("verdict"))


def candidate_record(scores: Column, gold: Column) -> Column:
    """(rank, correct, margin, nll) of the gold candidate: rank 0 is best, ties go to the lower place; the margin is to the best other."""
    own = F.get(scores, gold)
    rank = F.size(F.filter(F.transform(scores, lambda s, i: (s > own) | ((s == own) & (i < gold))), lambda x: x))
    others = F.transform(F.filter(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["i"] != gold), lambda x: x["s"])
    return F.struct(rank.alias("rank"), (rank == 0).alias("correct"), F.coalesce(own - F.array_max(others), F.lit(0.0)).alias("margin"), (-own).alias("nll"))


def generation_summary(texts: DataFrame) -> DataFrame:
    """(n, stop_rate, mean_length, repeat_rate) of generations (stopped, n_tokens, repeats)."""
    return texts.agg(F.count("*").alias("n"), rate(F.col("stopped")).alias("stop_rate"), F.avg("n_tokens").alias("mean_length"), rate(F.col("repeats")).alias("repeat_rate"))


def recent_median(values: Column, n: int) -> Column:
    """The upper middle of the last n positive values, null without any."""
    kept = F.filter(values, lambda v: v > 0)
    last = F.sort_array(F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n))
    return F.get(last, F.floor(F.size(last) / 2).cast("int"))


def moving_average(values: Column, decay: float) -> Column:
    """Exponential moving average in the array's order, begun at the first value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(decay * a + (1 - decay) * v))


def folds(df: DataFrame, key: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """``df`` with a fold from 0, dealt in turn in a seeded order, so folds differ by one row at most; two-level."""
    keyed = df.withColumn("__h", order_key(seed, F.col(key)))
    ranked = running_total(keyed, hash_bucket(F.col("__h")), [F.col("__h"), F.col(key)], F.lit(1), "__place")
    return ranked.withColumn(name, F.pmod(F.col("__place") - 1, F.lit(k)).cast("int")).drop("__h", "__place")


def bootstrap(by: DataFrame, key: str, n_boot: int, seed: int = 7) -> DataFrame:
    """(mean, sigma, n_boot) of a ratio of sums over clusters (key, s, n): every cluster weighs Poisson(1) in each replicate.

    The weight is drawn from a hash of cluster and replicate, so any engine gets the same and nothing is resampled.
    """
    at, p, bounds = 0.0, 0.36787944117144233, []
    for k in range(6):
        at += p
        bounds.append((at, k))
        p /= k + 1
    each = by.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("u", draw(seed, F.col(key), F.col("b")))
    weight = reduce(lambda found, x: F.when(F.col("u") < x[0], x[1]).otherwise(found), reversed(bounds), F.lit(6))
    means = each.withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sigma"), F.count("m").alias("n_boot"))


def twin_differences(pairs: DataFrame, cluster: str) -> DataFrame:
    """(exit, mean, se, z, n) of the twin's excess b - a at every exit, se robust to clusters; pairs are (cluster, exit, a, b)."""
    by = pairs.groupBy("exit", cluster).agg(F.sum(F.col("b") - F.col("a")).alias("s"), F.count("*").alias("n"))
    total = by.groupBy("exit").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.count("*").alias("g"))
    m = F.col("ts") / F.col("tn")
    got = by.join(F.broadcast(total), "exit").groupBy("exit", "ts", "tn", "g").agg(F.sum(F.pow(F.col("s") - m * F.col("n"), 2)).alias("q"))  # a row for each exit
    se = F.sqrt(F.col("g") / F.nullif(F.col("g") - 1, F.lit(0)) * F.col("q")) / F.col("tn")
    return got.select("exit", m.alias("mean"), se.alias("se"), F.when(se > 0, m / se).when(m == 0, 0.0).alias("z"), F.col("tn").alias("n"))


def oracle_exits(ladders: DataFrame, x: str = "x") -> DataFrame:
    """(exit, share, oracle, headroom): how often each exit is the first of the least cost, the mean least cost, and what it saves on the last exit."""
    least = ladders.select(F.array_position(x, F.array_min(x)).cast("int").alias("exit"), F.array_min(x).alias("m"), F.element_at(x, -1).alias("last"))
    whole = least.agg(F.count("*").alias("n"), F.avg("m").alias("oracle"), (F.avg("last") - F.avg("m")).alias("headroom"))
    return least.groupBy("exit").agg(F.count("*").alias("k")).crossJoin(F.broadcast(whole)).select("exit", (F.col("k") / F.col("n")).alias("share"), "oracle", "headroom")  # one row


def exit_means(ladders: DataFrame, x: str = "x") -> DataFrame:
    """(exit, mean, n) over arrays of a value for each exit."""
    return ladders.select(F.posexplode(x).alias("i", "v")).groupBy((F.col("i") + 1).alias("exit")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def between_depths(means: Column, passes: Column) -> Column:
    """The linear mix of the two depths around a mean number of passes, cut off to the depths that there are."""
    t = F.size(means)
    p = F.least(F.greatest(passes, F.lit(1.0)), t.cast("double"))
    low = F.least(F.floor(p).cast("int"), F.greatest(t - 1, F.lit(1)))
    return F.when(t == 1, F.get(means, F.lit(0))).otherwise(F.get(means, low - 1) * (1 - (p - low)) + F.get(means, low) * (p - low))


def concentration(weights: Column, top: int) -> Column:
    """(entropy, largest, mass) of a weight array; mass is that of its ``top`` largest."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    entropy = F.aggregate(weights, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.log(v)).otherwise(0.0))
    return F.struct(entropy.alias("entropy"), F.array_max(weights).alias("largest"), total(F.slice(F.sort_array(weights, asc=False), 1, top)).alias("mass"))


def abstention_report(records: DataFrame) -> DataFrame:
    """(condition, n, precision, recall, f1, false_abstention, em, token_f1, correct, non_abstain, em_real) of answers by condition.

    ``records`` has condition, abstained, unanswerable (of its own), em, f1. Abstaining is right where the condition or the question has no
    answer; em and token_f1 are over the others; non_abstain and em_real (over the questions with an answer of their own) are read where
    the condition has none.
    """
    lost = F.col("condition").isin("distractors", "none")
    none = F.col("unanswerable") | lost
    right = F.when(none, F.col("abstained").cast("double")).otherwise(F.when(F.col("abstained"), 0.0).otherwise(F.col("em")))
    by = records.withColumns({"none": none, "right": right}).groupBy("condition").agg(
        F.count("*").alias("n"), F.count_if(F.col("abstained") & F.col("none")).alias("tp"), F.count_if(F.col("abstained") & ~F.col("none")).alias("fp"), F.count_if(~F.col("abstained") & F.col("none")).alias("fn"), F.count_if(~F.col("none")).alias("open"),
        F.avg(F.when(~F.col("none"), F.col("em"))).alias("em"), F.avg(F.when(~F.col("none"), F.col("f1"))).alias("token_f1"), F.avg("right").alias("correct"), rate(~F.col("abstained")).alias("answered"), F.avg(F.when(~F.col("unanswerable"), F.col("em"))).alias("real"),
    )
    part = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return by.select("condition", "n", part("tp", F.col("tp") + F.col("fp")).alias("precision"), part("tp", F.col("tp") + F.col("fn")).alias("recall"), (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"), part("fp", F.col("open")).alias("false_abstention"), "em", "token_f1", "correct", F.when(lost, F.col("answered")).alias("non_abstain"), F.when(lost, F.col("real")).alias("em_real"))


def usable_slice(rows: DataFrame, usable: Column, key: str, offset: int, n: int, seed: int = 0) -> DataFrame:
    """``n`` usable rows of a seeded order after the first ``offset`` usable ones; two-level."""
    kept = rows.where(usable).withColumn("__h", order_key(seed, F.col(key)))
    placed = running_total(kept, hash_bucket(F.col("__h")), [F.col("__h"), F.col(key)], F.lit(1), "place")
    return placed.where(F.col("place").between(offset + 1, offset + n)).drop("__h")


def closed_book_items(people: DataFrame, attributes: list[str], pools: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(key, attribute, gold, candidates): an item for each person and attribute with n - 1 other values of the attribute's pool.

    ``pools`` has attribute and value and is small: a seeded walk of the pool from a place of the item's own takes them, shuffled with the gold.
    """
    stacked = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("gold")) for a in attributes)))
    items = people.select("key", stacked.alias("x")).select("key", "x.attribute", "x.gold")
    listed = pools.distinct().groupBy("attribute").agg(F.array_sort(F.collect_list(F.struct(order_key(seed, F.col("value")).alias("h"), "value"))).alias("pool"))
    met = items.join(F.broadcast(listed), "attribute")  # a row for each attribute
    others = F.filter(F.transform("pool", lambda p: p["value"]), lambda v: v != F.col("gold"))
    start = F.floor(draw(seed, F.col("key"), F.col("attribute")) * F.size(others)).cast("int")
    around = F.slice(F.concat(others, others), start + 1, F.least(F.lit(n - 1), F.size(others)))
    mixed = F.transform(F.array_sort(F.transform(F.array_append(around, F.col("gold")), lambda v: F.struct(order_key(seed, F.col("key"), F.col("attribute"), v).alias("h"), v.alias("v")))), lambda s: s["v"])
    return met.select("key", "attribute", "gold", mixed.alias("candidates"))


def retained(saves: DataFrame, every: int, tag: str = "tag", run: str = "run") -> DataFrame:
    """The first save of each run at or past each multiple of ``every``."""
    before = F.lag(tag).over(Window.partitionBy(run).orderBy(tag))
    return saves.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.floor(F.col(tag) / every) > F.floor(F.col("__before") / every)).drop("__before")


def elapsed_seconds(text: Column) -> Column:
    """Seconds of ``D-HH:MM:SS``, ``HH:MM:SS`` or ``MM:SS``, null for anything else."""
    part = lambda i: F.coalesce(F.regexp_extract(text, r"^(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)$", i).try_cast("long"), F.lit(0))
    return F.when(text.rlike(r"^(?:(?:\d+-)?\d+:)?\d+:\d+$"), part(1) * 86_400 + part(2) * 3600 + part(3) * 60 + part(4))


def step_line(line: Column) -> Column:
    """(step, of, loss, rate) of a log line ``step 10/100 loss 2.5 12.3 it/s``, null for another."""
    pattern = r"step (\d+)/(\d+).*?loss ([\d.]+).*?([\d.]+) it/s"
    get = lambda i, kind: F.regexp_extract(line, pattern, i).try_cast(kind)
    return F.when(line.rlike(pattern), F.struct(get(1, "long").alias("step"), get(2, "long").alias("of"), get(3, "double").alias("loss"), get(4, "double").alias("rate")))


def waterfall(short: DataFrame, receivers: DataFrame) -> DataFrame:
    """(name, given) of an excess that receivers take in order up to their room; ``short`` has one column excess, receivers place, name, room."""
    by = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # receivers are a handful
    ahead = receivers.withColumn("before", F.coalesce(F.sum("room").over(by), F.lit(0.0)))
    left = F.greatest(F.col("excess") - F.col("before"), F.lit(0.0))
    return ahead.crossJoin(F.broadcast(short)).select("name", F.least(left, "room").alias("given"))


def swap_reading(scores: Column, gold: Column, swap: Column) -> Column:
    """(norm_rank, follow, mr_ll) of a substitute among the candidates: its rank from 0 to 1, ties half, whether it is first, and sigmoid(gold - swap)."""
    own = F.get(scores, swap)
    rank = F.size(F.filter(scores, lambda s: s > own)) + 0.5 * (F.size(F.filter(scores, lambda s: s == own)) - 1)
    return F.struct((rank / F.greatest(F.size(scores) - 1, F.lit(1))).alias("norm_rank"), (rank == 0).alias("follow"), sigmoid_ratio(F.get(scores, gold), own).alias("mr_ll"))


def ridge_folds(df: DataFrame, x: str, y: str, fold: str, penalty: float) -> DataFrame:
    """(fold, n, slope, intercept, mse) of a ridge line fitted outside each fold and measured in it, from one pass of sums by fold."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = {"n": F.count("*").cast("double"), "x": F.sum(a), "y": F.sum(b), "xx": F.sum(a * a), "xy": F.sum(a * b), "yy": F.sum(b * b)}
    by = df.groupBy(fold).agg(*(e.alias(c) for c, e in sums.items()))
    whole = by.agg(*(F.sum(c).alias(f"t{c}") for c in sums))
    r = {c: F.col(f"t{c}") - F.col(c) for c in sums}
    mx, my = r["x"] / r["n"], r["y"] / r["n"]
    slope = (r["xy"] - r["n"] * mx * my) / (r["xx"] - r["n"] * mx * mx + penalty)
    fitted = by.crossJoin(F.broadcast(whole)).withColumns({"slope": slope, "mx": mx, "my": my})  # one row
    fitted = fitted.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    s, i = F.col("slope"), F.col("intercept")
    mse = (F.col("yy") - 2 * s * F.col("xy") - 2 * i * F.col("y") + s * s * F.col("xx") + 2 * s * i * F.col("x") + F.col("n") * i * i) / F.col("n")
    return fitted.select(fold, F.col("n").cast("long").alias("n"), "slope", "intercept", mse.alias("mse"))


def relation_plan(facts: DataFrame, n: int, least: int, seed: int = 42) -> DataFrame:
    """(id, relation, candidates): the object of each fact among n - 1 others of its relation that aren't answers, in a drawn order.

    ``facts`` has id, relation, object and answers. Relations of fewer than ``least`` distinct objects are left out; objects of one
    relation are gathered into a row and broadcast, so they must be few.
    """
    pools = facts.select("relation", "object").distinct().groupBy("relation").agg(F.array_sort(F.collect_list(F.struct(order_key(seed, F.col("object")).alias("h"), F.col("object").alias("o")))).alias("p"))
    met = facts.join(F.broadcast(pools.where(F.size("p") >= least)), "relation")  # a row for each relation
    others = F.filter(F.transform("p", lambda x: x["o"]), lambda o: ~F.array_contains("answers", o))
    start = F.floor(draw(seed, F.col("id")) * F.size("others")).cast("int")
    made = met.withColumn("others", others).withColumn("near", F.slice(F.concat("others", "others"), start + 1, F.least(F.lit(n - 1), F.size("others"))))
    mixed = F.transform(F.array_sort(F.transform(F.array_append("near", F.col("object")), lambda v: F.struct(order_key(seed, F.col("id"), v).alias("h"), v.alias("v")))), lambda s: s["v"])
    return made.select("id", "relation", mixed.alias("candidates"))

"""Queries of evaluation and planning reports, over records made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.functions import renders as D, text as T
from textloom.operators import mixing, relations, reports as R
from textloom.plans import renders as Q
from textloom.plans.corpus import DOC_TOKENS, DRAW, documents, lengths
from textloom.plans.evaluation import ladder
from textloom.plans.registry import register
from textloom.plans.rows import ENCODED, encoded_chats
from textloom.storage import table


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_LEN = f"SELECT doc_id, source, len({DOC_TOKENS}) AS n_tokens FROM documents"
_GOALS = {f"src{i}": 10_000 * (i + 1) for i in range(21)}
_GOALS_SQL = "(VALUES " + ", ".join(f"('{s}', {n})" for s, n in _GOALS.items()) + ") g(source, target)"


@register("realised_tokens", f"SELECT g.source, coalesce(docs, 0) AS docs, coalesce(tokens, 0)::BIGINT AS tokens, target::BIGINT AS target, round(100.0 * (coalesce(tokens, 0) - target) / target, 4) AS off FROM {_GOALS_SQL} LEFT JOIN (SELECT source, count(*) AS docs, sum(n_tokens) AS tokens FROM ({_LEN}) GROUP BY 1) d USING (source)")
def realised_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.realised(lengths(spark, sf), _GOALS), "off", digits=4)


@register("supervised_share", f"WITH e AS ({ENCODED}), b AS (SELECT conv_id % 3 AS slice, sum(list_sum(mask))::BIGINT AS supervised FROM e GROUP BY 1) SELECT slice, supervised, round(supervised / (SELECT sum(supervised) FROM b), 6) AS share FROM b")
def supervised_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.supervised_share(encoded_chats(spark, sf).withColumn("slice", F.col("conv_id") % 3), "slice"), "share")


@register("share_problems", f"WITH s AS (SELECT source, sum(n_tokens) / sum(sum(n_tokens)) OVER () AS share FROM ({_LEN}) GROUP BY 1) SELECT source, round(coalesce(share, 0), 6) AS share, target FROM (VALUES ('src0', 0.05::DOUBLE), ('src1', 0.2), ('none', 0.1)) g(source, target) LEFT JOIN s USING (source) WHERE abs(coalesce(share, 0) - target) > 0.03")
def share_problems(spark: SparkSession, sf: str) -> DataFrame:
    by = lengths(spark, sf).groupBy("source").agg(F.sum("n_tokens").alias("t"))
    shares = by.withColumn("share", F.col("t") / F.sum("t").over(Window.partitionBy()))  # a row for each source
    return rounded(R.share_problems(shares, {"src0": 0.05, "src1": 0.2, "none": 0.1}, 0.03), "share")


_OPTIONS = "SELECT l_returnflag AS flag, l_orderkey % 3 AS task, l_orderkey AS item, CASE WHEN l_orderkey % 7 = 0 THEN 9 ELSE count(*) OVER (PARTITION BY l_orderkey) END AS n_options, l_linenumber - 1 AS place, l_orderkey % 2 AS gold, -l_extendedprice / 20000 AS logprob, l_quantity::INT AS n_bytes, 1 + l_orderkey % 3 AS n_tokens FROM lineitem"


@register("task_summary", f"""
WITH o AS ({_OPTIONS}), i AS (SELECT task, item, count(*) AS k, max(n_options) AS m, max(gold) AS gold, arg_max(place, (logprob, -place)) AS a, arg_max(place, (logprob / n_bytes, -place)) AS b, sum(CASE WHEN place = gold THEN logprob END) AS lp, sum(CASE WHEN place = gold THEN n_tokens END) AS t FROM o GROUP BY ALL)
SELECT task, count(*) AS n, round(avg((a = gold)::INT), 6) AS acc, round(avg((b = gold)::INT), 6) AS acc_norm, round(stddev_samp((a = gold)::INT) / sqrt(count(*)), 6) AS se, round(exp(least(-sum(lp) / greatest(sum(t), 1), 20)), 4) AS ppl, round(exp(least(-sum(lp) / count(*), 60)), 4) AS ppl_doc FROM i WHERE k = m GROUP BY task""")  # fmt: skip
def task_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey")
    n = F.when(k % 7 == 0, 9).otherwise(F.count("*").over(Window.partitionBy("l_orderkey")))
    options = table(spark, sf, "lineitem").select((k % 3).alias("task"), k.alias("item"), n.alias("n_options"), (F.col("l_linenumber") - 1).alias("place"), (k % 2).alias("gold"), (-F.col("l_extendedprice") / 20000).alias("logprob"), F.col("l_quantity").cast("int").alias("n_bytes"), (1 + k % 3).alias("n_tokens"))
    return rounded(rounded(R.task_summary(options), "acc", "acc_norm", "se"), "ppl", "ppl_doc", digits=4)


@register("attempts_summary", "WITH i AS (SELECT l_orderkey AS item, arg_min((l_discount > 0.06)::INT, l_extendedprice) AS first, bool_or(l_discount > 0.06) AS a FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg(first), 6) AS em, round(stddev_samp(first) / sqrt(count(*)), 6) AS se, round(avg(a::INT), 6) AS pass_k FROM i")
def attempts_summary(spark: SparkSession, sf: str) -> DataFrame:
    tries = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_extendedprice").alias("attempt"), (F.col("l_discount") > 0.06).alias("hit"))
    return rounded(R.attempts_summary(tries), "em", "se", "pass_k")


_READ = "SELECT o_orderpriority AS source, ['none', 'gold', 'distractors'][o_orderkey % 3 + 1] AS condition, o_totalprice / 100000 AS ce, 1 + o_custkey % 50 AS tokens FROM orders"


@register("condition_contrasts", f"""
WITH r AS ({_READ}), w AS (SELECT source, {', '.join(f"sum(ce * tokens) FILTER (condition = '{c}') / sum(tokens) FILTER (condition = '{c}') AS {c}_" for c in ('none', 'gold', 'distractors'))}, sum(tokens) FILTER (condition = 'gold') AS tokens FROM r GROUP BY ROLLUP (source))
SELECT coalesce(source, 'all') AS source, round(none_, 6) AS "none", round(gold_, 6) AS gold, round(distractors_, 6) AS distractors, round(none_ - gold_, 6) AS ceiling, round(distractors_ - gold_, 6) AS content, tokens::BIGINT AS tokens FROM w""")  # fmt: skip
def condition_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    which = F.get(F.array(*map(F.lit, ("none", "gold", "distractors"))), (F.col("o_orderkey") % 3).cast("int"))
    read = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), which.alias("condition"), (F.col("o_totalprice") / 100000).alias("ce"), (1 + F.col("o_custkey") % 50).alias("tokens"))
    return rounded(R.condition_contrasts(read), "none", "gold", "distractors", "ceiling", "content")


_CF = "SELECT c_custkey AS id, CASE WHEN n < 10 THEN '1-9' WHEN n < 20 THEN '10-99' ELSE '100-999' END AS stratum, c_acctbal > -500 AS follow, c_acctbal < -900 AS stuck, c_acctbal / 1000 AS ll_orig, n / 5.0 AS ll_swap, (c_custkey % 3 > 0)::INT::DOUBLE AS gold_em FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"


def _counterfactuals(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    b = F.col("c_acctbal")
    stratum = F.when(F.col("n") < 10, "1-9").when(F.col("n") < 20, "10-99").otherwise("100-999")
    rows = table(spark, sf, "customer").join(n, "c_custkey").select(F.col("c_custkey").alias("id"), stratum.alias("stratum"), (b > -500).alias("follow"), (b < -900).alias("stuck"), (b / 1000).alias("ll_orig"), (F.col("n") / 5.0).alias("ll_swap"), (F.col("c_custkey") % 3 > 0).cast("double").alias("gold_em"))
    return rows.withColumn("mr_ll", T.sigmoid_ratio(F.col("ll_orig"), F.col("ll_swap")))


@register("follow_readings", f"""
WITH r AS (SELECT *, 1 / (1 + exp(ll_swap - ll_orig)) AS mr FROM ({_CF})), s AS (SELECT 'all_eligible' AS items, * FROM r UNION ALL SELECT 'correct_with_gold', * FROM r WHERE gold_em = 1),
b AS (SELECT items, coalesce(stratum, 'all') AS stratum, count(*) AS n, count(*) FILTER (follow) AS f, count(*) FILTER (stuck) AS k, avg(mr) AS mr FROM s GROUP BY GROUPING SETS ((items, stratum), (items)))
SELECT items, stratum, n, f AS n_follow, k AS n_stuck, round(f / n, 6) AS follow_rate, round(k / nullif(k + f, 0), 6) AS mr_gen, round(mr, 6) AS mr_ll, CASE WHEN n < 30 THEN 'n too small' WHEN k / nullif(k + f, 0) <= 0.05 AND f / n >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS gate FROM b""")  # fmt: skip
def follow_readings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.follow_readings(_counterfactuals(spark, sf)), "follow_rate", "mr_gen", "mr_ll")


@register("likelihood_readings", f"SELECT coalesce(stratum, 'all') AS stratum, count(*) AS n, round(avg(1 / (1 + exp(ll_swap - ll_orig))), 6) AS mr_ll, round(avg((ll_swap > ll_orig)::INT), 6) AS prefers_swap FROM ({_CF}) GROUP BY ROLLUP (stratum)")
def likelihood_readings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.likelihood_readings(_counterfactuals(spark, sf)), "mr_ll", "prefers_swap")


@register("flip_rates", """
WITH l AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'edit' ELSE 'delete' END AS kind, CASE WHEN kind = 'edit' AND o_custkey % 10 > 0 THEN 'follow' WHEN o_custkey % 5 = 0 THEN 'stuck' WHEN kind = 'delete' AND o_custkey % 3 = 0 THEN 'abstained' ELSE 'other' END AS label FROM orders),
r AS (SELECT kind, count(*) AS n, avg((CASE WHEN kind = 'edit' THEN label = 'follow' ELSE label <> 'stuck' END)::INT) AS f FROM l GROUP BY kind) SELECT kind, n, round(f, 6) AS flip_rate, round(sqrt(f * (1 - f) / n), 6) AS sigma, f >= 0.9 AS pass FROM r""")  # fmt: skip
def flip_rates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    labels = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "edit").otherwise("delete").alias("kind"), c)
    labels = labels.withColumn("label", R.edit_label(F.col("kind"), c % 10 > 0, c % 5 == 0, c % 3 == 0))
    return rounded(R.flip_rates(labels), "flip_rate", "sigma")


_CELLS = "SELECT l_suppkey % 5 AS kept, l_linenumber % 4 + 1 AS hops, count(*) AS n, avg((l_discount > 0.07)::INT) AS acc, 0.25 AS chance FROM lineitem GROUP BY ALL"


@register("validity", f"""
WITH c AS (SELECT *, sqrt(chance * (1 - chance) / n) AS s FROM ({_CELLS})), f AS (SELECT count(*) FILTER (kept < hops AND abs(acc - chance) > 3 * s) AS failing, count(*) FILTER (hops = 1 AND kept >= 1 AND NOT (acc - chance) / s >= 3) AS unreadable, count(*) FILTER (hops = 1 AND kept >= 1) AS firsts FROM c)
SELECT failing = 0 AND firsts > 0 AND unreadable = 0 AS valid, firsts > 0 AND unreadable = 0 AS readable, failing, unreadable FROM f""")  # fmt: skip
def validity(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("kept"), (F.col("l_linenumber") % 4 + 1).alias("hops")).agg(F.count("*").alias("n"), F.avg((F.col("l_discount") > 0.07).cast("int")).alias("acc"), F.lit(0.25).alias("chance"))
    return R.validity(cells)


@register("micro_verdict", """
WITH d AS (SELECT o_orderpriority AS form, ['full', 'masked', 'retrieval'][o_orderkey % 3 + 1] AS arm, ['1', '10', '100', '1000'][o_custkey % 4 + 1] AS tier, o_totalprice / 100000 - 1.5 AS z FROM orders WHERE o_custkey % 50 < 4),
v AS (SELECT form, coalesce(bool_or(arm = 'full' AND tier IN ('100', '1000') AND z > 3), false) AS climbs, coalesce(bool_or(arm IN ('masked', 'retrieval') AND tier IN ('1', '10', '100') AND abs(z) > 3), false) AS leaks FROM d GROUP BY form) SELECT form, CASE WHEN NOT climbs THEN 'UNINFORMATIVE' WHEN NOT leaks THEN 'HOLDS' ELSE 'FAILS' END AS verdict FROM v""")  # fmt: skip
def micro_verdict(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda names, c: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    deltas = table(spark, sf, "orders").where("o_custkey % 50 < 4").select(F.col("o_orderpriority").alias("form"), one(("full", "masked", "retrieval"), F.col("o_orderkey") % 3).alias("arm"), one(("1", "10", "100", "1000"), F.col("o_custkey") % 4).alias("tier"), (F.col("o_totalprice") / 100000 - 1.5).alias("z"))
    return R.micro_verdict(deltas)


_LADDER = "SELECT o_custkey AS g, list(o_totalprice / 100000 ORDER BY o_orderkey) AS x FROM orders GROUP BY 1"


@register("candidate_records", f"""
WITH l AS (SELECT g, x, (g % len(x))::INT AS gold FROM ({_LADDER})) SELECT g, len([i for i in range(0, len(x)) if x[i + 1] > x[gold + 1] OR (x[i + 1] = x[gold + 1] AND i < gold)])::INT AS rank,
round(coalesce(x[gold + 1] - list_max(list_concat(x[:gold], x[gold + 2:])), 0), 6) AS margin, round(-x[gold + 1], 6) AS nll FROM l""")  # fmt: skip
def candidate_records(spark: SparkSession, sf: str) -> DataFrame:
    made = ladder(spark, sf).select("g", R.candidate_record(F.col("x"), F.pmod("g", F.size("x")).cast("int")).alias("r"))
    return rounded(made.select("g", "r.rank", "r.margin", "r.nll"), "margin", "nll")


@register("oracle_exits", f"""
WITH l AS (SELECT list_position(x, list_min(x))::INT AS exit, list_min(x) AS m, x[-1] AS last FROM ({_LADDER})) SELECT exit, round(count(*) / sum(count(*)) OVER (), 6) AS share, round((SELECT avg(m) FROM l), 6) AS oracle, round((SELECT avg(last) - avg(m) FROM l), 6) AS headroom FROM l GROUP BY exit""")  # fmt: skip
def oracle_exits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.oracle_exits(ladder(spark, sf)), "share", "oracle", "headroom")


@register("exit_means", f"SELECT i::INT AS exit, round(avg(x[i]), 6) AS mean, count(*) AS n FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM ({_LADDER})) GROUP BY i")
def exit_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.exit_means(ladder(spark, sf)), "mean")


@register("depth_mix", f"WITH l AS (SELECT g, x, least(greatest(g % 9 / 2.0, 1), len(x))::DOUBLE AS p FROM ({_LADDER})), m AS (SELECT *, least(floor(p), greatest(len(x) - 1, 1))::INT AS low FROM l) SELECT g, round(CASE WHEN len(x) = 1 THEN x[1] ELSE x[low] * (1 - (p - low)) + x[low + 1] * (p - low) END, 6) AS mix FROM m")
def depth_mix(spark: SparkSession, sf: str) -> DataFrame:
    return ladder(spark, sf).select("g", F.round(R.between_depths(F.col("x"), (F.col("g") % 9) / 2.0), 6).alias("mix"))


@register("concentration", f"WITH w AS (SELECT g, [v / list_sum(x) for v in x] AS w FROM ({_LADDER})) SELECT g, round(list_sum([-v * ln(v) for v in w]), 6) AS entropy, round(list_max(w), 6) AS largest, round(list_sum(list_reverse_sort(w)[:3]), 6) AS mass FROM w")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    made = ladder(spark, sf).withColumn("t", total).select("g", F.transform("x", lambda v: v / F.col("t")).alias("w"))
    return rounded(made.select("g", R.concentration(F.col("w"), 3).alias("c")).select("g", "c.*"), "entropy", "largest", "mass")


@register("twin_differences", """
WITH p AS (SELECT l_linenumber AS exit, l_orderkey % 97 AS c, l_tax - l_discount AS d FROM lineitem), b AS (SELECT exit, c, sum(d) AS s, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT exit, sum(s) / sum(n) AS m, sum(n) AS tn, count(*) AS g FROM b GROUP BY exit),
e AS (SELECT exit, any_value(m) AS m, any_value(tn) AS tn, sqrt(any_value(g / (g - 1)) * sum(pow(s - m * n, 2))) / any_value(tn) AS se FROM b JOIN t USING (exit) GROUP BY exit) SELECT exit, round(m, 6) AS mean, round(se, 8) AS se, round(m / se, 4) AS z, tn::BIGINT AS n FROM e""")  # fmt: skip
def twin_differences(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("exit"), (F.col("l_orderkey") % 97).alias("c"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return rounded(rounded(rounded(R.twin_differences(pairs, "c"), "mean"), "se", digits=8), "z", digits=4)


def _boot_sql(by: str, n_boot: int) -> str:
    """Bootstrap SQL over (key, s, n)."""
    at, p, cases = 0.0, 0.36787944117144233, ""
    for k in range(6):
        at += p
        cases += f" WHEN u < {at!r} THEN {k}"
        p /= k + 1
    return f"""WITH c AS ({by}), w AS (SELECT *, CASE{cases} ELSE 6 END AS w FROM (SELECT c.*, b, {DRAW.format("'7:' || key || ':' || b")} AS u FROM c, (SELECT unnest(range(1, {n_boot + 1})) AS b)))
SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sigma, count(m) AS n_boot FROM (SELECT sum(w * s) / nullif(sum(w * n), 0) AS m FROM w GROUP BY b)"""


@register("bootstrap", _boot_sql("SELECT l_orderkey % 997 AS key, sum(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY 1", 50))
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(997)).alias("key")).agg(F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    return rounded(R.bootstrap(by, "key", 50), "mean", "sigma")


@register("item_bootstrap", _boot_sql("SELECT c_custkey AS key, c_acctbal AS s, 1 AS n FROM customer", 40))
def item_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("s"), F.lit(1).alias("n"))
    return rounded(R.bootstrap(by, "key", 40), "mean", "sigma")


@register("paired_bootstrap", _boot_sql("SELECT a.o_orderkey AS key, (b.o_totalprice > 150000)::INT - (a.o_totalprice > 150000)::INT AS s, 1 AS n FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 10 = 0", 40))
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    hit = lambda name: table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).cast("int").alias(name))
    pairs = hit("a").where("o_orderkey % 10 = 0").join(hit("b").withColumn("o_orderkey", F.col("o_orderkey") - 1), "o_orderkey")
    return rounded(R.bootstrap(pairs.select(F.col("o_orderkey").alias("key"), (F.col("b") - F.col("a")).alias("s"), F.lit(1).alias("n")), "key", 40), "mean", "sigma")


@register("generation_summary", f"WITH t AS (SELECT text, {DOC_TOKENS} AS t FROM conversations WHERE role = 'assistant' AND text IS NOT NULL), g AS (SELECT text, len(t) AS n, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))] AS g FROM t) SELECT count(*) AS n, round(avg((text LIKE '%.')::INT), 6) AS stop_rate, round(avg(n), 4) AS mean_length, round(avg((len(g) <> len(list_distinct(g)))::INT), 6) AS repeat_rate FROM g")
def generation_summary(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").where("role = 'assistant' AND text IS NOT NULL").withColumn("t", T.tokens(F.col("text")))
    made = said.select(F.endswith("text", F.lit(".")).alias("stopped"), F.size("t").alias("n_tokens"), T.has_repeated_ngram(F.col("t"), 2).alias("repeats"))
    return rounded(rounded(R.generation_summary(made), "stop_rate", "repeat_rate"), "mean_length", digits=4)


_RATES = "SELECT user_id, list(value - 5 ORDER BY ts, event_id) AS v FROM events GROUP BY 1"


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.transform(ordered, lambda e: e["value"] - 5).alias("v"))


@register("recent_medians", f"WITH k AS (SELECT user_id, list_sort(list_filter(v, lambda x: x > 0)[-9:]) AS l, v FROM ({_RATES})) SELECT user_id, round(l[len(l) // 2 + 1], 6) AS median, round(list_reduce(v, lambda a, x: 0.9 * a + 0.1 * x), 6) AS average FROM k")
def recent_medians(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_rates(spark, sf).select("user_id", R.recent_median(F.col("v"), 9).alias("median"), R.moving_average(F.col("v"), 0.9).alias("average")), "median", "average")


@register("fold_recall", "WITH f AS (SELECT vec_id, label, (row_number() OVER (ORDER BY sha1('0:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings) SELECT fold::INT AS fold, count(*) AS n, round(avg((label < 3)::INT), 6) AS recall FROM f GROUP BY fold")
def fold_recall(spark: SparkSession, sf: str) -> DataFrame:
    dealt = R.folds(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 5)
    return rounded(dealt.groupBy("fold").agg(F.count("*").alias("n"), R.rate(F.col("label") < 3).alias("recall")), "recall")


_ANSWERED = "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'mixed' WHEN 2 THEN 'distractors' ELSE 'none' END AS condition, o_custkey % 3 = 0 AS abstained, o_custkey % 4 = 0 AS unanswerable, (o_custkey % 5 < 2)::INT::DOUBLE AS em, (o_custkey % 11) / 10.0 AS f1 FROM orders"


@register("abstention_report", f"""
WITH a AS (SELECT *, condition IN ('distractors', 'none') AS lost, unanswerable OR lost AS nothing FROM ({_ANSWERED})), b AS (SELECT condition, any_value(lost) AS lost, count(*) AS n, count(*) FILTER (abstained AND nothing) AS tp, count(*) FILTER (abstained AND NOT nothing) AS fp, count(*) FILTER (NOT abstained AND nothing) AS fn, count(*) FILTER (NOT nothing) AS open,
avg(em) FILTER (NOT nothing) AS em, avg(f1) FILTER (NOT nothing) AS token_f1, avg(CASE WHEN nothing THEN abstained::INT WHEN abstained THEN 0 ELSE em END) AS correct, avg((NOT abstained)::INT) AS answered, avg(em) FILTER (NOT unanswerable) AS real FROM a GROUP BY condition)
SELECT condition, n, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(open, 0), 6) AS false_abstention, round(em, 6) AS em, round(token_f1, 6) AS token_f1, round(correct, 6) AS correct,
CASE WHEN lost THEN round(answered, 6) END AS non_abstain, CASE WHEN lost THEN round(real, 6) END AS em_real FROM b""")  # fmt: skip
def abstention_report(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    records = table(spark, sf, "orders").select(F.when(k == 0, "gold").when(k == 1, "mixed").when(k == 2, "distractors").otherwise("none").alias("condition"), (c % 3 == 0).alias("abstained"), (c % 4 == 0).alias("unanswerable"), (c % 5 < 2).cast("double").alias("em"), ((c % 11) / 10.0).alias("f1"))
    return rounded(R.abstention_report(records), "precision", "recall", "f1", "false_abstention", "em", "token_f1", "correct", "non_abstain", "em_real")


@register("usable_slice", f"SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY sha1('0:' || doc_id), doc_id) AS place FROM ({_LEN}) WHERE n_tokens BETWEEN 20 AND 400) WHERE place BETWEEN 31 AND 90")
def usable_slice(spark: SparkSession, sf: str) -> DataFrame:
    return R.usable_slice(lengths(spark, sf), F.col("n_tokens").between(20, 400), "doc_id", 30, 60).select("doc_id", "place")


@register("closed_book_items", f"""
WITH p AS (SELECT *, unnest(['city', 'trade']) AS attribute FROM ({Q.PEOPLE})), i AS (SELECT key, attribute, CASE attribute WHEN 'city' THEN city ELSE trade END AS gold FROM p), l AS (SELECT DISTINCT attribute, gold AS value FROM i),
o AS (SELECT i.key, i.attribute, i.gold, list(l.value ORDER BY sha1('42:' || l.value)) AS others FROM i JOIN l ON l.attribute = i.attribute AND l.value <> i.gold GROUP BY ALL),
t AS (SELECT *, floor({DRAW.format("'42:' || key || ':' || attribute")} * len(others))::INT AS s FROM o), c AS (SELECT key, attribute, gold, list_concat(list_concat(others, others)[s + 1:s + least(4, len(others))], [gold]) AS cs FROM t)
SELECT key, attribute, gold, array_to_string([x.v for x in list_sort([{{'h': sha1('42:' || key || ':' || attribute || ':' || v), 'v': v}} for v in cs])], '|') AS candidates FROM c""")  # fmt: skip
def closed_book_items(spark: SparkSession, sf: str) -> DataFrame:
    own = Q.people(spark, sf)
    pools = own.select(F.lit("city").alias("attribute"), F.col("city").alias("value")).unionByName(own.select(F.lit("trade").alias("attribute"), F.col("trade").alias("value")))
    return R.closed_book_items(own, ["city", "trade"], pools, 5).withColumn("candidates", F.array_join("candidates", "|"))


@register("four_way_deltas", """
WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS tier, o_totalprice / 1000000 AS a, (o_custkey % 100) / 100.0 AS b FROM orders), p AS (SELECT o_orderkey AS id, (o_custkey % 70) / 70.0 AS a, o_totalprice / 500000 AS b FROM orders WHERE o_custkey % 2 = 0)
SELECT coalesce(tier, 'all') AS tier, count(*) AS n, round(avg(p.a - r.a), 6) AS delta_a, round(avg(p.b - r.b), 6) AS delta_b, round(avg((p.a - r.a) - (p.b - r.b)), 6) AS diff FROM r JOIN p USING (id) GROUP BY ROLLUP (tier)""")  # fmt: skip
def four_way_deltas(spark: SparkSession, sf: str) -> DataFrame:
    orders, c, price = table(spark, sf, "orders"), F.col("o_custkey"), F.col("o_totalprice")
    real, twins = F.col("o_orderkey").cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit("|prior"))
    scored = lambda own, prior: orders.select(real.alias("id"), F.col("o_orderstatus").alias("tier"), own.alias("rank")).unionByName(orders.where(c % 2 == 0).select(twins.alias("id"), F.col("o_orderstatus").alias("tier"), prior.alias("rank")))
    a = relations.prior_delta(scored(price / 1_000_000, (c % 70) / 70.0), "|prior", "delta_a")
    b = relations.prior_delta(scored((c % 100) / 100.0, price / 500_000), "|prior", "delta_b").drop("tier")
    by = a.join(b, "id").rollup("tier").agg(F.count("*").alias("n"), F.avg("delta_a").alias("delta_a"), F.avg("delta_b").alias("delta_b"), F.avg(F.col("delta_a") - F.col("delta_b")).alias("diff"))
    return rounded(by.withColumn("tier", F.coalesce("tier", F.lit("all"))), "delta_a", "delta_b", "diff")


@register("rank_breakdown", """
SELECT coalesce(cls, 'all') AS cls, coalesce(tier, 'all') AS tier, coalesce(relation, 'all') AS relation, count(*) AS n, round(avg(rank), 6) AS rank, round(avg((rank < 0.02)::INT), 6) AS top1
FROM (SELECT CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'entity' ELSE 'noun' END AS cls, l_returnflag AS tier, l_linestatus AS relation, l_discount AS rank FROM lineitem) GROUP BY GROUPING SETS ((cls, tier), (cls, relation), (cls))""")  # fmt: skip
def rank_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    cls = F.when(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"), "entity").otherwise("noun")
    rows = table(spark, sf, "lineitem").select(cls.alias("cls"), F.col("l_returnflag").alias("tier"), F.col("l_linestatus").alias("relation"), F.col("l_discount").alias("rank"))
    by = rows.withColumn("top", (F.col("rank") < 0.02).cast("double")).groupingSets([["cls", "tier"], ["cls", "relation"], ["cls"]], "cls", "tier", "relation").agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("rank"), F.round(F.avg("top"), 6).alias("top1"))
    return by.select(*(F.coalesce(c, F.lit("all")).alias(c) for c in ("cls", "tier", "relation")), "n", "rank", "top1")


@register("best_models", """
WITH s AS (SELECT l_returnflag AS task, l_linestatus || l_linenumber % 2 AS model, avg(l_discount) AS score FROM lineitem GROUP BY ALL), h AS (SELECT *, (score - 0.02) / 0.98 AS headroom, max(score) OVER (PARTITION BY task) AS top FROM s)
SELECT task, model, round(score, 6) AS score, round(headroom, 6) AS headroom, score = top AS best, round(avg(headroom) OVER (PARTITION BY model), 6) AS mean FROM h""")  # fmt: skip
def best_models(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("task"), F.concat("l_linestatus", (F.col("l_linenumber") % 2).cast("string")).alias("model")).agg(F.avg("l_discount").alias("score"))
    return rounded(relations.compared(by, {"A": 0.02, "N": 0.02, "R": 0.02}), "score", "headroom", "mean")


@register("published_values", "WITH s AS (SELECT l_returnflag AS metric, avg(l_discount) AS value FROM lineitem GROUP BY 1) SELECT metric, round(value, 6) AS value, published, CASE WHEN value IS NULL THEN 'missing' WHEN abs(value - published) <= 0.0005 THEN 'ok' ELSE 'off' END AS verdict FROM (VALUES ('A', 0.05::DOUBLE), ('N', 0.06), ('X', 0.1)) p(metric, published) LEFT JOIN s USING (metric)")
def published_values(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.avg("l_discount").alias("value"))
    known = spark.createDataFrame([("A", 0.05), ("N", 0.06), ("X", 0.1)], "metric string, published double")
    verdict = F.when(F.col("value").isNull(), "missing").when(F.abs(F.col("value") - F.col("published")) <= 0.0005, "ok").otherwise("off")
    return rounded(known.join(got, "metric", "left").withColumn("verdict", verdict), "value")


@register("bridge_statistics", f"""
WITH c AS (SELECT key, city, region, trade, CASE key % 3 WHEN 0 THEN 'Step 1: ' || city || '. Step 2: x. Answer: y.' WHEN 1 THEN 'It is ' || city || ' in ' || region ELSE 'Answer: ' || region END AS said FROM ({Q.PEOPLE})), h AS (SELECT contains(said, 'Answer:') AS marked, [regexp_matches(said, '\\b' || city || '\\b'), regexp_matches(said, '\\b' || region || '\\b')] AS hits, key % 5 > 1 AS correct FROM c)
SELECT round(avg(marked::INT), 6) AS marker_rate, round(avg(hits[1]::INT), 6) AS hit1, round(avg(hits[2]::INT), 6) AS hit2, round(avg(correct::INT) FILTER (marked), 6) AS acc_marker, round(avg(correct::INT) FILTER (hits[1] AND hits[2]), 6) AS acc_all, round(avg(correct::INT) FILTER (NOT (hits[1] AND hits[2])), 6) AS acc_part FROM h""")  # fmt: skip
def bridge_statistics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("key") % 3
    said = F.when(k == 0, F.concat(F.lit("Step 1: "), "city", F.lit(". Step 2: x. Answer: y."))).when(k == 1, F.concat(F.lit("It is "), "city", F.lit(" in "), "region")).otherwise(F.concat(F.lit("Answer: "), "region"))
    rows = Q.people(spark, sf).select(said.alias("said"), F.array("name", "city", "region", "trade").alias("e"), (F.col("key") % 5 > 1).cast("double").alias("c"))
    rows = rows.select(F.contains("said", F.lit(D.MARKER)).alias("marked"), D.bridge_hits(F.col("said"), F.col("e")).alias("h"), "c")
    full = F.forall("h", lambda x: x)
    flat = rows.select("marked", "c", full.alias("full"), F.get("h", F.lit(0)).cast("double").alias("h1"), F.get("h", F.lit(1)).cast("double").alias("h2"))
    return rounded(flat.agg(R.rate(F.col("marked")).alias("marker_rate"), F.avg("h1").alias("hit1"), F.avg("h2").alias("hit2"), F.avg(F.when(F.col("marked"), F.col("c"))).alias("acc_marker"), F.avg(F.when(F.col("full"), F.col("c"))).alias("acc_all"), F.avg(F.when(~F.col("full"), F.col("c"))).alias("acc_part")), "marker_rate", "hit1", "hit2", "acc_marker", "acc_all", "acc_part")


@register("answer_tally", """
WITH a AS (SELECT l_linenumber % 3 + 1 AS hops, l_discount > 0.05 AS ok, 1.0 / (2 + l_suppkey % 3) AS chance, -l_tax * 10 AS lp, 1 + l_partkey % 4 AS t FROM lineitem), b AS (SELECT hops, count(*) AS n, avg(ok::INT) AS acc, avg(chance) AS chance, -sum(lp) / sum(t) AS ce FROM a GROUP BY hops)
SELECT hops, n, round(acc, 6) AS acc, round(chance, 6) AS chance, round(ce, 6) AS ce, round((acc - chance) / sqrt(chance * (1 - chance) / n), 4) AS z FROM b""")  # fmt: skip
def answer_tally(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 3 + 1).alias("hops")).agg(F.count("*").alias("n"), F.avg((F.col("l_discount") > 0.05).cast("double")).alias("acc"), F.avg(1.0 / (2 + F.col("l_suppkey") % 3)).alias("chance"), (F.sum(F.col("l_tax") * 10) / F.sum(1 + F.col("l_partkey") % 4)).alias("ce"))
    return rounded(rounded(rows.withColumn("z", R.z_against(F.col("acc"), F.col("chance"), F.col("n"))), "acc", "chance", "ce"), "z", digits=4)


# --- plans and runs


@register("slice_union", f"""
WITH t AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id) AS upto, sum(n_tokens) OVER (PARTITION BY source) AS total FROM ({_LEN})), p AS (SELECT *, (upto - n_tokens * {DRAW.format("'42:' || source || ':' || doc_id")}) / total AS place FROM t)
SELECT doc_id, row_number() OVER (ORDER BY place, source, doc_id) AS position FROM p""")  # fmt: skip
def slice_union(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.slice_union(lengths(spark, sf)).select("doc_id", "position")


_SHARES = {f"src{i}": float(1 + i % 3) for i in range(6)}
_GOAL = "CASE source " + " ".join(f"WHEN '{s}' THEN {int(60_000 * w / sum(_SHARES.values()))}" for s, w in _SHARES.items()) + " END"
_MERGE = f"""
p AS (SELECT d.*, pass FROM ({_LEN}) d, (SELECT unnest([1, 2]) AS pass) WHERE n_tokens > 0 AND source IN ({', '.join(f"'{s}'" for s in _SHARES)})), r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY pass, sha1('42:' || pass || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS running FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY running) AS k, count(*) OVER (PARTITION BY source) AS n FROM r WHERE running <= {_GOAL}), m AS (SELECT *, row_number() OVER (ORDER BY (k - 0.5) / n, source) AS position FROM k)"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.merge(lengths(spark, sf), _SHARES, 60_000, 2)


@register("merged_order", f"WITH {_MERGE} SELECT position, source, k, doc_id, pass FROM m")
def merged_order(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("position", "source", "k", "doc_id", "pass")


@register("merge_report", f"""
WITH {_MERGE}, o AS (SELECT source, sum(n_tokens) AS own FROM ({_LEN}) GROUP BY 1)
SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, round(sum(n_tokens) / sum(sum(n_tokens)) OVER (), 6) AS share, round((1 + substr(source, 4)::INT % 3) / {sum(_SHARES.values())}, 6) AS target_share, round(sum(n_tokens) / any_value(own), 6) AS passes, sum(('0x' || substr(sha1(k || ':' || doc_id), 1, 8))::BIGINT)::VARCHAR AS digest FROM m JOIN o USING (source) GROUP BY source""")  # fmt: skip
def merge_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.merge_report(merged(spark, sf), lengths(spark, sf), _SHARES)


@register("replayed_order", f"WITH {_MERGE} SELECT position, source, doc_id + 1000000 AS doc_id FROM m")
def replayed_order(spark: SparkSession, sf: str) -> DataFrame:
    recorded = merged(spark, sf)
    other = recorded.select("source", "k", (F.col("doc_id") + 1_000_000).alias("doc_id"))
    return mixing.replayed(recorded.select("position", "source", "k"), other).select("position", "source", "doc_id")


@register("prefix_problems", f"WITH {_MERGE} SELECT position, source, n_tokens FROM m WHERE position <= 40 AND position % 9 = 0")
def prefix_problems(spark: SparkSession, sf: str) -> DataFrame:
    whole = merged(spark, sf).select("position", "source", "n_tokens")
    changed = whole.withColumn("n_tokens", F.when(F.col("position") % 9 == 0, F.col("n_tokens") + 1).otherwise(F.col("n_tokens")))
    return mixing.prefix_problems(whole.where("position <= 40"), changed, ["source", "n_tokens"])


@register("shuffle_check", f"SELECT false AS docs_equal, sum(n_tokens) FILTER (doc_id % 40 = 0) = 0 AS tokens_equal, count(*) FILTER (doc_id % 40 = 0)::BIGINT AS missing, 0::BIGINT AS extra FROM ({_LEN})")
def shuffle_check(spark: SparkSession, sf: str) -> DataFrame:
    docs = lengths(spark, sf)
    return mixing.shuffle_check(docs, docs.where("doc_id % 40 <> 0"))


@register("supply_plan", f"""
WITH s AS (SELECT source, sum(n_tokens) AS supply, count(*) AS docs FROM ({_LEN}) GROUP BY 1) SELECT source, least(0.06 * 100000, supply)::DOUBLE AS given, ceil(least(0.06 * 100000, supply)::DOUBLE * 1.1::DOUBLE / (supply / docs))::BIGINT + 1 AS files, supply < 0.06 * 100000 AS short FROM s""")  # fmt: skip
def supply_plan(spark: SparkSession, sf: str) -> DataFrame:
    by = lengths(spark, sf).groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("docs"))
    want = F.lit(0.06 * 100_000)
    given = F.least(want, "supply").cast("double")
    return by.select("source", given.alias("given"), (F.ceil(given * 1.1 / (F.col("supply") / F.col("docs"))) + 1).alias("files"), (F.col("supply") < want).alias("short"))


@register("budget_problems", f"WITH s AS (SELECT source, sum(n_tokens) AS t, count(*) AS n FROM ({_LEN}) GROUP BY 1) SELECT source, unnest(list_filter([CASE WHEN t > 21000 THEN 'over budget' END, CASE WHEN 22000 / t > 1.2 THEN 'repeats too often' END, CASE WHEN t < 15000 THEN 'short' END], lambda x: x IS NOT NULL)) AS problem FROM s")
def budget_problems(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    rules = F.array(F.when(t > 21_000, "over budget"), F.when(22_000 / t > 1.2, "repeats too often"), F.when(t < 15_000, "short"))
    by = lengths(spark, sf).groupBy("source").agg(F.sum("n_tokens").alias("t"))
    return by.select("source", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("problem"))


@register("order_head", f"WITH {_MERGE} SELECT count(*) AS head FROM m WHERE position < (SELECT min(position) FROM m WHERE doc_id % 50 = 49)")
def order_head(spark: SparkSession, sf: str) -> DataFrame:
    order = merged(spark, sf).select("position", (F.col("doc_id") % 50 != 49).alias("covered"))
    end = order.where(~F.col("covered")).agg(F.min("position").alias("end"))
    return order.join(F.broadcast(end), F.col("position") < F.col("end")).agg(F.count("*").alias("head"))  # one row


_NEEDS = [("mix", "documents"), ("mix", "labels"), ("search", "embeddings"), ("search", "index"), ("chat", "conversations")]


@register("requirements", "SELECT stage, needs, needs IN ('documents', 'labels', 'embeddings', 'conversations') AS present, bool_and(needs IN ('documents', 'labels', 'embeddings', 'conversations')) OVER (PARTITION BY stage) AS ready FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NEEDS) + ") n(stage, needs)")
def requirements(spark: SparkSession, sf: str) -> DataFrame:
    there = spark.createDataFrame([(x,) for x in ("documents", "labels", "embeddings", "conversations", "pages")], "needs string")
    needs = spark.createDataFrame(_NEEDS, "stage string, needs string").join(F.broadcast(there.withColumn("there", F.lit(True))), "needs", "left")
    return needs.select("stage", "needs", F.coalesce("there", F.lit(False)).alias("present")).withColumn("ready", F.bool_and("present").over(Window.partitionBy("stage")))


_JOBS = "SELECT ['train', 'eval', 'prep'][user_id % 3 + 1] AS kind, CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 3 = 0 THEN (event_id % 2) || '-' || lpad((event_id % 24)::VARCHAR, 2, '0') || ':10:05' ELSE lpad((event_id % 60)::VARCHAR, 2, '0') || ':30' END AS elapsed, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 3 = 0 THEN event_id % 2 * 86400 + event_id % 24 * 3600 + 605 ELSE event_id % 60 * 60 + 30 END AS s FROM events"


@register("job_hours", f"SELECT kind, count(*) AS jobs, round(sum(s) / 3600.0, 4) AS hours FROM ({_JOBS}) GROUP BY kind")
def job_hours(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    line = F.concat_ws("|", F.get(F.array(*map(F.lit, ("train", "eval", "prep"))), (F.col("user_id") % 3).cast("int")), F.when(e % 9 == 0, "n/a").when(e % 3 == 0, F.concat((e % 2).cast("string"), F.lit("-"), two(e % 24), F.lit(":10:05"))).otherwise(F.concat(two(e % 60), F.lit(":30"))))
    jobs = table(spark, sf, "events").select(F.split(line, r"\|").alias("f")).select(F.get("f", F.lit(0)).alias("kind"), R.elapsed_seconds(F.get("f", F.lit(1))).alias("s"))
    return rounded(jobs.groupBy("kind").agg(F.count("*").alias("jobs"), (F.sum("s") / 3600.0).alias("hours")), "hours", digits=4)


@register("retained_saves", "WITH s AS (SELECT user_id, event_id, lag(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, event_id FROM s WHERE event_id // 500 > b // 500")
def retained_saves(spark: SparkSession, sf: str) -> DataFrame:
    return R.retained(table(spark, sf, "events").select("user_id", "event_id"), 500, "event_id", "user_id")


@register("log_projection", "SELECT event_id, event_id AS step, round(value, 2) AS loss, round((100000 - event_id) / (1 + user_id), 4) AS eta FROM events WHERE event_id % 5 <> 0")
def log_projection(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("event_id") % 5 == 0, "saved").otherwise(F.format_string("[x] step %d/100000 | loss %.2f | %d it/s", "event_id", "value", F.col("user_id") + 1))
    read = table(spark, sf, "events").select("event_id", R.step_line(line).alias("x")).where("x IS NOT NULL")
    return read.select("event_id", "x.step", "x.loss", F.round((F.col("x.of") - F.col("x.step")) / F.col("x.rate"), 4).alias("eta"))


@register("waterfall", "WITH r AS (SELECT r_regionkey AS place, r_name AS name, (r_regionkey + 1) * 10.0::DOUBLE AS room FROM region), b AS (SELECT *, coalesce(sum(room) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r) SELECT name, least(greatest(75 - b, 0), room)::DOUBLE AS given FROM b")
def waterfall(spark: SparkSession, sf: str) -> DataFrame:
    receivers = table(spark, sf, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("name"), ((F.col("r_regionkey") + 1) * 10.0).alias("room"))
    return R.waterfall(spark.range(1).select(F.lit(75.0).alias("excess")), receivers)


@register("consumption_order", "WITH f AS (SELECT source, doc_id // 10 AS file, (substr(source, 4)::INT % 3) AS phase FROM documents GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source, phase ORDER BY file) / count(*) OVER (PARTITION BY source, phase) AS fraction FROM f) SELECT source, file, row_number() OVER (ORDER BY phase, fraction, source, file) AS position FROM k")
def consumption_order(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 10).alias("file"), (F.substring("source", 4, 9).cast("int") % 3).alias("phase")).distinct()
    return relations.consumption_order(files).select("source", "file", "position")


@register("byte_budget_sample", "WITH f AS (SELECT source, doc_id, strlen(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) % 2 AS half FROM documents), r AS (SELECT *, sum(b) OVER (PARTITION BY source, half ORDER BY sha1('5:' || doc_id), doc_id) AS upto FROM f) SELECT source, half::INT AS half, count(*) AS docs, sum(b)::BIGINT AS bytes FROM r WHERE upto - b < 20000 GROUP BY ALL")
def byte_budget_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", F.octet_length("text").alias("b"))
    numbered = mixing.grouped_total(docs, "source", F.floor(F.col("doc_id") / 4096), [F.col("doc_id")], F.lit(1), "k").withColumn("half", (F.col("k") % 2).cast("int")).withColumn("slice", F.concat_ws(":", "source", (F.col("k") % 2).cast("string")))
    keyed = numbered.withColumn("h", T.order_key(5, F.col("doc_id")))
    summed = mixing.grouped_total(keyed, "slice", mixing.hash_bucket(F.col("h")), [F.col("h"), F.col("doc_id")], F.col("b"), "upto")
    return summed.where(F.col("upto") - F.col("b") < 20_000).groupBy("source", "half").agg(F.count("*").alias("docs"), F.sum("b").alias("bytes"))


@register("round_trips", f"SELECT source, count(*) AS docs, count(*) FILTER (text IS DISTINCT FROM array_to_string({DOC_TOKENS}, ' ')) AS changed FROM documents GROUP BY source")
def round_trips(spark: SparkSession, sf: str) -> DataFrame:
    back = F.array_join("tokens", " ")
    return documents(spark, sf).groupBy("source").agg(F.count("*").alias("docs"), F.sum((~F.col("text").eqNullSafe(back)).cast("long")).alias("changed"))


@register("holdout_lists", "SELECT CASE WHEN substr(source, 4)::INT < 10 THEN 'one' ELSE 'two' END AS phase, count(DISTINCT substr(sha1(text), 1, 16)) AS hashes, min(substr(sha1(text), 1, 16)) AS first FROM documents GROUP BY 1")
def holdout_lists(spark: SparkSession, sf: str) -> DataFrame:
    phase = F.when(F.substring("source", 4, 9).cast("int") < 10, "one").otherwise("two")
    kept = table(spark, sf, "documents").select(phase.alias("phase"), T.content_hash(F.col("text")).alias("hash")).distinct()
    return kept.groupBy("phase").agg(F.count("*").alias("hashes"), F.min("hash").alias("first"))


@register("shard_order", "SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY sha1('11:' || source || ':' || shard)) AS place FROM (SELECT DISTINCT source, doc_id // 10 AS shard FROM documents)")
def shard_order(spark: SparkSession, sf: str) -> DataFrame:
    shards = table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 10).alias("shard")).distinct().withColumn("h", T.order_key(11, F.col("source"), F.col("shard")))
    return mixing.grouped_total(shards, "source", mixing.hash_bucket(F.col("h")), [F.col("h")], F.lit(1), "place").select("source", "shard", "place")


@register("sidecar_backfill", "SELECT doc_id, n_chars, upper(lang) AS extra FROM documents")
def sidecar_backfill(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return relations.backfilled(old, old.withColumn("extra", F.upper("lang")), "doc_id", "extra").select("doc_id", "n_chars", "extra")


@register("share_maps", "SELECT c_custkey, round(x / (x + y), 6) AS a, round(y / (x + y), 6) AS b, 'path' || c_custkey AS path, 1 + c_custkey % 3 AS passes FROM (SELECT c_custkey, (1 + c_custkey % 5)::DOUBLE AS x, 2.5::DOUBLE AS y FROM customer)")
def share_maps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    told = F.concat(F.lit("a:"), (1 + k % 5).cast("string"), F.lit(",b:2.5"))
    slice_of = F.concat(F.lit("a=path"), k.cast("string"), F.lit(":0.5:"), (1 + k % 3).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", relations.normalised_shares(told).alias("m"), relations.slice_argument(slice_of).alias("s")).select("c_custkey", F.round(F.col("m")["a"], 6).alias("a"), F.round(F.col("m")["b"], 6).alias("b"), "s.path", "s.passes")


@register("json_fields", "SELECT event_id, (props->>'k')::BIGINT AS k, date_diff('second', TIMESTAMP '2024-01-01', ts)::BIGINT AS since, md5(props) AS digest FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    since = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), since.alias("since"), F.md5("props").alias("digest"))


@register("token_ids", f"WITH c AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) - 1 AS id FROM (SELECT unnest({DOC_TOKENS}) AS t FROM documents) GROUP BY t) SELECT item_id, array_to_string([x.i for x in list_sort(list({{'p': p, 'i': coalesce(id, -1)::VARCHAR}}))], ' ') AS ids FROM (SELECT item_id, unnest({DOC_TOKENS}) AS t, unnest(range(0, len({DOC_TOKENS}))) AS p FROM benchmark) LEFT JOIN c USING (t) GROUP BY item_id")
def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    from textloom.operators import tokens

    vocabulary = tokens.vocabulary(documents(spark, sf).select("tokens"))
    items = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text")).alias("tokens"))
    return tokens.with_ids(items, vocabulary, "item_id").select("item_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@register("swap_readings", f"""
WITH l AS (SELECT g, x, (g % len(x))::INT AS a, ((g + 1) % len(x))::INT AS b FROM ({_LADDER}) WHERE len(x) > 1), r AS (SELECT *, len([v for v in x if v > x[b + 1]]) + 0.5 * (len([v for v in x if v = x[b + 1]]) - 1) AS r FROM l)
SELECT g, round(r / (len(x) - 1), 6)::DOUBLE AS norm_rank, r = 0 AS follow, round(1 / (1 + exp(x[b + 1] - x[a + 1])), 6) AS mr_ll FROM r""")  # fmt: skip
def swap_readings(spark: SparkSession, sf: str) -> DataFrame:
    own = ladder(spark, sf).where(F.size("x") > 1)
    place = lambda n: F.pmod(F.col("g") + n, F.size("x")).cast("int")
    return rounded(own.select("g", R.swap_reading(F.col("x"), place(0), place(1)).alias("r")).select("g", "r.*"), "norm_rank", "mr_ll").withColumn("norm_rank", F.col("norm_rank").cast("double"))


@register("ridge_folds", """
WITH d AS (SELECT doc_id % 4 AS fold, length(text)::DOUBLE / 1000 AS x, strlen(text)::DOUBLE / 900 AS y FROM documents), s AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy FROM d GROUP BY fold),
t AS (SELECT f.fold, sum(s.n) AS n, sum(s.sx) / sum(s.n) AS mx, sum(s.sy) / sum(s.n) AS my, sum(s.xx) AS xx, sum(s.xy) AS xy FROM s f JOIN s ON s.fold <> f.fold GROUP BY f.fold), c AS (SELECT fold, (xy - n * mx * my) / (xx - n * mx * mx + 2.0) AS slope, mx, my FROM t), e AS (SELECT fold, slope, my - slope * mx AS icept FROM c)
SELECT d.fold, count(*) AS n, round(any_value(slope), 6) AS slope, round(any_value(icept), 6) AS intercept, round(avg(pow(y - slope * x - icept, 2)), 6) AS mse FROM d JOIN e USING (fold) GROUP BY d.fold""")  # fmt: skip
def ridge_folds(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("fold"), (F.length("text") / 1000).alias("x"), (F.octet_length("text") / 900).alias("y"))
    return rounded(R.ridge_folds(docs, "x", "y", "fold", 2.0), "slope", "intercept", "mse")


@register("relation_plan", f"""
WITH f AS ({Q._FACTS}), l AS (SELECT DISTINCT relation, object FROM f), z AS (SELECT relation FROM l GROUP BY 1 HAVING count(*) >= 10), o AS (SELECT f.id, f.relation, f.object, list(l.object ORDER BY sha1('42:' || l.object)) AS others FROM f JOIN z USING (relation) JOIN l ON l.relation = f.relation AND NOT list_contains(list_append(f.answers, f.object), l.object) GROUP BY ALL),
c AS (SELECT *, list_append(list_concat(others, others)[floor({DRAW.format("'42:' || id")} * len(others))::INT + 1:floor({DRAW.format("'42:' || id")} * len(others))::INT + least(5, len(others))], object) AS cs FROM o)
SELECT id, relation, array_to_string([x.v for x in list_sort([{{'h': sha1('42:' || id || ':' || v), 'v': v}} for v in cs])], '|') AS candidates FROM c""")  # fmt: skip
def relation_plan(spark: SparkSession, sf: str) -> DataFrame:
    return R.relation_plan(Q._facts(spark, sf), 6, 10).withColumn("candidates", F.array_join("candidates", "|"))

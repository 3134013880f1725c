"""Queries that evaluate: scores, hits, ranks, searches and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.functions import text as T
from textloom.operators import metrics as M, vectors as V
from textloom.plans.corpus import TOKENS
from textloom.plans.registry import register
from textloom.storage import table

#: Score and label pairs: document length against quality.
_SCORED = "SELECT d.doc_id, d.source, d.n_chars AS score, least(d.n_chars / 10000.0, 1.0) AS conf, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("score"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("conf"))
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@register("auroc", f"""
WITH s AS ({_SCORED}), r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auroc, sum(quality)::BIGINT AS n_pos, sum(1 - quality)::BIGINT AS n_neg FROM r""")  # fmt: skip
def auroc(spark: SparkSession, sf: str) -> DataFrame:
    return M.auroc(scored(spark, sf), "score", "quality").withColumn("auroc", F.round("auroc", 6))


@register("calibration_error", f"SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM (SELECT count(*) AS n, avg(conf) AS c, avg(quality::DOUBLE) AS a FROM ({_SCORED}) GROUP BY greatest(ceil(conf * 15) - 1, 0))")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return M.calibration_error(scored(spark, sf), "conf", "quality").withColumn("ece", F.round("ece", 6))


@register("confusion_by_source", f"""
WITH c AS (SELECT source, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM (SELECT source, score > 1500 AS p, quality = 1 AS a FROM ({_SCORED})) GROUP BY source)
SELECT source, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")  # fmt: skip
def confusion_by_source(spark: SparkSession, sf: str) -> DataFrame:
    got = M.confusion(scored(spark, sf), F.col("score") > 1500, F.col("quality") == 1, ["source"])
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register("threshold_sweep", f"""
WITH s AS ({_SCORED}), c AS (SELECT unnest([0, 1, 2]) AS point, unnest(quantile_cont(score::DOUBLE, [0.25, 0.5, 0.75])) AS threshold FROM s)
SELECT point, threshold, count(*) FILTER (score >= threshold AND quality = 1) AS tp, count(*) FILTER (score >= threshold AND quality = 0) AS fp, count(*) FILTER (score < threshold AND quality = 1) AS fn FROM s, c GROUP BY ALL""")  # fmt: skip
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return M.threshold_sweep(scored(spark, sf), "score", "quality", [0.25, 0.5, 0.75])


@register("cluster_se", """
WITH b AS (SELECT l_orderkey % 997 AS c, sum(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(s) AS ts, sum(n) AS tn, count(*) AS g FROM b)
SELECT round(any_value(ts / tn), 6) AS mean, round(sqrt(any_value(g / (g - 1)) * sum(pow(s - ts / tn * n, 2))) / any_value(tn), 8) AS se, any_value(tn)::BIGINT AS n, any_value(g) AS clusters FROM b, t""")  # fmt: skip
def cluster_se(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_discount", F.pmod("l_orderkey", F.lit(997)).alias("c"))
    return M.cluster_mean_se(lines, "l_discount", "c").withColumns({"mean": F.round("mean", 6), "se": F.round("se", 8)})


@register("paired_counts", f"""
WITH c AS (SELECT count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) AS n FROM (SELECT quality = 1 AS a, score > 1500 AS b FROM ({_SCORED})))
SELECT a_only, b_only, n, round((a_only - b_only) / n, 6) AS diff, round(sqrt(a_only + b_only - pow(a_only - b_only, 2) / n) / n, 6) AS sigma, round((a_only - b_only) / sqrt(a_only + b_only - pow(a_only - b_only, 2) / n), 6) AS z FROM c""")  # fmt: skip
def paired_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits = scored(spark, sf).select((F.col("quality") == 1).alias("a"), (F.col("score") > 1500).alias("b"))
    return M.paired_counts(hits, "a", "b").withColumns({c: F.round(c, 6) for c in ("diff", "sigma", "z")})


@register("equal_count_bins", "SELECT bin::INT AS bin, count(*) AS n, round(avg(score), 4) AS mean, round(avg(quality), 6) AS rate FROM (SELECT score, quality, ntile(10) OVER (ORDER BY score, doc_id) AS bin FROM (" + _SCORED + ")) GROUP BY bin")
def equal_count_bins(spark: SparkSession, sf: str) -> DataFrame:
    binned = M.equal_count_bins(scored(spark, sf), "score", "doc_id", 10)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.avg("quality"), 6).alias("rate"))


@register("tertile_tiers", "WITH q AS (SELECT quantile_cont(c_acctbal, [1/3.0, 2/3.0]) AS c FROM customer) SELECT CASE WHEN c_acctbal <= c[1] THEN 'low' WHEN c_acctbal <= c[2] THEN 'mid' ELSE 'high' END AS tier, count(*) AS n FROM customer, q GROUP BY 1")
def tertile_tiers(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select("c_acctbal")
    low, high = M.quantiles(people, "c_acctbal", [1 / 3, 2 / 3])
    tier = F.when(F.col("c_acctbal") <= low, "low").when(F.col("c_acctbal") <= high, "mid").otherwise("high")
    return people.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@register("frequency_strata", "SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 9 THEN '1-9' WHEN n <= 99 THEN '10-99' WHEN n <= 999 THEN '100-999' ELSE '1000+' END AS stratum, count(*) AS tokens FROM (SELECT count(*) AS n FROM (SELECT unnest(" + TOKENS.format("text") + ") AS t FROM documents) GROUP BY t) GROUP BY 1")
def frequency_strata(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return counts.groupBy(T.frequency_stratum(F.col("n")).alias("stratum")).agg(F.count("*").alias("tokens"))


_NORM = "list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@register("token_f1", f"""
WITH p AS (SELECT a.item_id, a.text AS said, b.text AS other FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), r AS (SELECT item_id, {_NORM.format("said")} AS a, unnest([other, CASE WHEN item_id % 4 = 0 THEN 'The ' || said || '!' ELSE 'nothing' END]) AS ref FROM p),
q AS (SELECT item_id, a, {_NORM.format("ref")} AS b FROM r), m AS (SELECT item_id, a = b AS same_all, len(a) + len(b) AS n, list_sum([least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))) for t in list_distinct(a)]) AS same FROM q)
SELECT item_id, round(max(2.0 * same / n), 6) AS f1, bool_or(same_all) AS exact FROM m GROUP BY item_id""")  # fmt: skip
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select("item_id", "text")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    references = F.array("other", F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("The "), "text", F.lit("!"))).otherwise("nothing"))
    return pairs.select("item_id", M.answer_scores(F.col("text"), references).alias("x")).select("item_id", F.round("x.f1", 6).alias("f1"), "x.exact")


_LADDER = "SELECT o_custkey AS g, list(o_totalprice / 100000 ORDER BY o_orderkey) AS x FROM orders GROUP BY 1"


def ladder(spark: SparkSession, sf: str) -> DataFrame:
    """An array of numbers for each customer, as a model's exits would give."""
    near = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.struct("o_orderkey", (F.col("o_totalprice") / 100000).alias("v")).alias("s"))
    return near.groupBy("g").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("x"))


@register("exit_rules", f"""
SELECT g, (list_position(x, list_min(x)) - 1)::INT AS best, list_min(x) AS least,
       coalesce(list_position([v >= 2 for v in x], true) - 1, len(x) - 1)::INT AS chosen, round(1 + len([v for v in x if v > x[1]]) + 0.5 * (len([v for v in x if v = x[1]]) - 1), 2)::DOUBLE AS rank_of_first FROM ({_LADDER})""")  # fmt: skip
def exit_rules(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    return ladder(spark, sf).select("g", (F.array_position(x, F.array_min(x)) - 1).cast("int").alias("best"), F.array_min(x).alias("least"), M.first_confident(x, 2.0).cast("int").alias("chosen"), M.rank_of_gold(x, F.lit(0)).cast("double").alias("rank_of_first"))


@register("softmax_allocation", f"""
WITH w AS (SELECT g, [exp(-(v - list_min(x))) for v in x] AS w FROM ({_LADDER})), p AS (SELECT g, [v / list_sum(w) for v in w] AS p FROM w)
SELECT g, round(list_max(p), 6) AS top, round(list_sum([CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END for v in p]), 6) AS entropy FROM p""")  # fmt: skip
def softmax_allocation(spark: SparkSession, sf: str) -> DataFrame:
    p = ladder(spark, sf).select("g", M.softmax(F.col("x"), 1.0).alias("p"))
    return p.select("g", F.round(F.array_max("p"), 6).alias("top"), F.round(M.entropy(F.col("p")), 6).alias("entropy"))


@register("lower_hull", """
WITH p AS (SELECT n_nationkey::DOUBLE AS x, (n_nationkey * 7 % 25)::DOUBLE AS y FROM nation), s AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM p a JOIN p b ON a.x <= b.x)
SELECT p.x, round(min(CASE WHEN x0 = x1 THEN least(y0, y1) ELSE y0 + (y1 - y0) * (p.x - x0) / (x1 - x0) END), 6) AS hull FROM p JOIN s ON x0 <= p.x AND p.x <= x1 GROUP BY p.x""")  # fmt: skip
def lower_hull(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "nation").select(F.col("n_nationkey").cast("double").alias("x"), (F.col("n_nationkey") * 7 % 25).cast("double").alias("y"))
    return M.lower_hull(points, points.select("x")).withColumn("hull", F.round("hull", 6))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_TOP = f"SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10"


@register("vector_top_k", f"SELECT qid, rank, id, score FROM ({_TOP})")
def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return V.top_k(keys(spark, sf).where("id % 20 = 0"), keys(spark, sf), 10).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@register("neighbour_share", f"SELECT t AS threshold, round(avg((m >= t)::INT), 6) AS share FROM (SELECT max(score) AS m FROM ({_TOP}) GROUP BY qid), (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS t) GROUP BY t")
def neighbour_share(spark: SparkSession, sf: str) -> DataFrame:
    best = vector_top_k(spark, sf).groupBy("qid").agg(F.max("score").alias("m")).withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    return best.groupBy("threshold").agg(F.round(F.avg((F.col("m") >= F.col("threshold")).cast("int")), 6).alias("share"))


@register("neighbours_in_label", f"""
SELECT a.vec_id AS id, b.vec_id AS other, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY rank <= 3""")  # fmt: skip
def neighbours_in_label(spark: SparkSession, sf: str) -> DataFrame:
    return V.neighbours_in_group(keys(spark, sf), "label", 3).withColumn("rank", F.col("rank").cast("long"))


@register("recall_at_k", f"""
WITH t AS (SELECT qid, list(id ORDER BY rank) AS top FROM ({_TOP}) GROUP BY qid), g AS (SELECT a.vec_id AS qid, list(b.vec_id) AS gold FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id IN (a.vec_id + 1, a.vec_id + 2, a.vec_id + 10) WHERE a.vec_id % 20 = 0 GROUP BY 1)
SELECT k, round(avg(list_has_any(gold, top[1:k])::INT), 6) AS any_hit, round(avg(list_has_all(top[1:k], gold)::INT), 6) AS all_hit, count(*) AS n FROM g JOIN t USING (qid), (SELECT unnest([1, 5, 10]) AS k) GROUP BY k""")  # fmt: skip
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    own = keys(spark, sf).select(F.col("id").alias("qid"), "label").where("qid % 20 = 0").withColumn("gold_id", F.explode(F.array(F.col("qid") + 1, F.col("qid") + 2, F.col("qid") + 10)))
    truth = own.join(keys(spark, sf).select(F.col("id").alias("gold_id"), F.col("label").alias("l")), "gold_id").where("label = l").groupBy("qid").agg(F.collect_list("gold_id").alias("gold"))
    return V.recall_at(vector_top_k(spark, sf), truth, [1, 5, 10])


@register("clustered_search")
def clustered_search(spark: SparkSession, sf: str) -> DataFrame:
    from textloom.storage import shared_dir

    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    own = keys(spark, sf).select("id", "vec")
    centers, assigned = V.balanced_kmeans(own, 8)
    return V.clustered_top_k(own.where("id % 20 = 0"), own, centers, assigned, 3, 10)


@register("grouped_report", "SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def grouped_report(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")), 4).alias("se"))
    return got.select(F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n", "mean", "se")


@register("comparison_pivot", "SELECT l_returnflag AS task, round(avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS f, round(avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS o, round((avg(l_discount) - 0.01) / 0.99, 6) AS headroom FROM lineitem GROUP BY 1")
def comparison_pivot(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("task"), "l_linestatus", "l_discount")
    wide = lines.groupBy("task").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_discount"), 6)).withColumnsRenamed({"F": "f", "O": "o"})
    return wide.join(lines.groupBy("task").agg(F.round((F.avg("l_discount") - 0.01) / 0.99, 6).alias("headroom")), "task")


@register("rolling_median", """
WITH s AS (SELECT user_id, row_number() OVER w AS k, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(min(m), 6) AS best FROM s WHERE k >= 10 AND (k - 10) % 5 = 0 GROUP BY user_id""")  # fmt: skip
def rolling_median(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = table(spark, sf, "events").select("user_id", F.row_number().over(by).alias("k"), F.sort_array(F.collect_list("value").over(by.rowsBetween(-9, 0))).alias("last")).where(F.size("last") == 10).withColumn("m", (F.col("last")[4] + F.col("last")[5]) / 2)
    return marked.where("k >= 10 AND (k - 10) % 5 = 0").groupBy("user_id").agg(F.round(F.min("m"), 6).alias("best"))

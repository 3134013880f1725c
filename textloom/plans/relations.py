"""Queries that join, order, number and compare rows in ways of their own, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.functions import text as T
from textloom.operators import metrics as M, relations as R
from textloom.operators.mixing import running_total
from textloom.plans.corpus import TOKENS
from textloom.plans.registry import register
from textloom.storage import table


@register("as_of_owner", """
WITH s AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS start FROM documents WHERE n_chars > 0)
SELECT s.doc_id, count(*) AS points, sum(l.l_orderkey)::BIGINT AS places FROM lineitem l ASOF JOIN s ON l.l_orderkey >= s.start GROUP BY s.doc_id""")  # fmt: skip
def as_of_owner(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", "n_chars")
    starts = running_total(docs, F.floor(F.col("doc_id") / 4096), [F.col("doc_id")], F.col("n_chars")).select("doc_id", (F.col("running") - F.col("n_chars")).alias("start"))
    owned = R.as_of(table(spark, sf, "lineitem").select("l_orderkey"), starts, "l_orderkey", "start", "doc_id", 1 << 12)
    return owned.groupBy("doc_id").agg(F.count("*").alias("points"), F.sum("l_orderkey").alias("places"))


_DAY = "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)"


@register("interval_overlap", f"""
WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, {_DAY} AS s, {_DAY} + 45 AS e FROM orders)
SELECT a.k AS o_custkey, count(*) AS pairs, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS days FROM o a JOIN o b ON a.k = b.k AND a.id < b.id AND a.s < b.e AND b.s < a.e GROUP BY a.k""")  # fmt: skip
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    side = lambda x: table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias(f"{x}_id"), day.alias(f"{x}_start"), (day + 45).alias(f"{x}_end"))
    met = R.overlaps(side("a"), side("b"), "o_custkey", 45).where("a_id < b_id")
    days = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return met.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.sum(days).alias("days"))


@register("event_runs", """
WITH m AS (SELECT user_id, event_type, ts, event_id, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
SELECT event_type, count(*) AS runs, max(n) AS longest, sum(n)::BIGINT AS events FROM (SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL) GROUP BY event_type""")  # fmt: skip
def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = R.runs(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return found.groupBy("event_type").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.sum("n").alias("events"))


@register("dense_renumbering", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def dense_renumbering(spark: SparkSession, sf: str) -> DataFrame:
    return R.renumbered(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("toxic = 1"), "doc_id", 4096)


@register("epoch_order", "SELECT doc_id, row_number() OVER (ORDER BY source <> 'src0', sha1('7:' || doc_id), doc_id) AS position FROM documents")
def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    return R.epoch_order(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", F.col("source") == "src0", 7).select("doc_id", "position")


@register("multiset_difference", "SELECT (SELECT count(*) FROM (SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, event_type FROM events WHERE value > 1))::BIGINT AS only_a, 0::BIGINT AS only_b")
def multiset_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    found = R.difference(rows.select("user_id", "event_type"), rows.where("value > 1").select("user_id", "event_type"))
    return found.select(*(F.col(c).cast("long") for c in ("only_a", "only_b")))


@register("choice_accuracy", """
WITH o AS (SELECT l_orderkey AS item, l_linenumber AS p, -l_extendedprice / 1000 AS s, l_quantity AS c, l_linenumber = 1 AS g FROM lineitem),
b AS (SELECT item, arg_max(g, (s, -p)) AS a, arg_max(g, (s / c, -p)) AS l, count(*) AS n FROM (SELECT * FROM o) GROUP BY item)
SELECT n AS options, count(*) AS items, round(avg(a::INT), 6) AS acc, round(avg(l::INT), 6) AS acc_norm FROM b GROUP BY n""")  # fmt: skip
def choice_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("place"), (-F.col("l_extendedprice") / 1000).alias("logprob"), F.col("l_quantity").alias("chars"), (F.col("l_linenumber") == 1).alias("gold"))
    best = R.choices(lines, "item", "logprob", "chars", "gold", "place")
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return best.groupBy(F.col("n").alias("options")).agg(F.count("*").alias("items"), rate("by_sum").alias("acc"), rate("by_length").alias("acc_norm"))


@register("tie_expectation", """
WITH t AS (SELECT l_orderkey AS item, l_returnflag AS f, l_linestatus AS s, l_quantity > 25 AS g, l_discount AS d FROM lineitem), m AS (SELECT item, d, count(*) FILTER (g) / count(*) AS e FROM t GROUP BY item, d)
SELECT round(avg(e), 6) AS expected, count(*) AS items FROM (SELECT item, arg_max(e, d) AS e FROM m GROUP BY item)""")  # fmt: skip
def tie_expectation(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), "l_discount", (F.col("l_quantity") > 25).alias("gold"))
    return R.tie_expectation(lines, "item", "l_discount", "gold").agg(F.round(F.avg("expected"), 6).alias("expected"), F.count("*").alias("items"))


@register("file_demand", """
WITH f AS (SELECT source, doc_id // 10 AS file, sum(n_chars) AS n FROM documents GROUP BY ALL), t AS (SELECT source, sum(n_chars) * 0.25 AS target FROM documents GROUP BY 1),
r AS (SELECT f.*, coalesce(sum(n) OVER (PARTITION BY source ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f)
SELECT source, count(*) AS files, sum(n)::BIGINT AS tokens FROM r JOIN t USING (source) WHERE b < target * 1.1 GROUP BY source""")  # fmt: skip
def file_demand(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").groupBy("source", F.floor(F.col("doc_id") / 10).alias("file")).agg(F.sum("n_chars").alias("n"))
    targets = files.groupBy("source").agg((F.sum("n") * 0.25).alias("target"))
    return R.demand(files.join(targets, "source"), "source", "file", "n", F.col("target"), 1.1)


@register("used_union", "SELECT l_suppkey, max(l_orderkey) AS cursor, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS every FROM lineitem GROUP BY 1")
def used_union(spark: SparkSession, sf: str) -> DataFrame:
    every = F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_orderkey").alias("cursor"), every.alias("every"))


@register("control_pairs", "SELECT a.p_partkey AS id, round(a.p_retailprice - b.p_retailprice, 4) AS diff FROM part a JOIN part b ON b.p_partkey::VARCHAR = a.p_partkey || '0'")
def control_pairs(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").alias("price"))
    real, control = parts.alias("a").withColumn("twin", F.concat("id", F.lit("0"))), parts.select(F.col("id").alias("twin"), F.col("price").alias("other"))
    return real.join(control, "twin").select(F.col("id").cast("long").alias("id"), F.round(F.col("price") - F.col("other"), 4).alias("diff"))


@register("vocabulary_budget", f"""
WITH c AS (SELECT t, count(*) AS n FROM (SELECT unnest({TOKENS.format("text")}) AS t FROM documents) GROUP BY t)
SELECT t AS token, n, row_number() OVER (ORDER BY n DESC, t) AS rank, round(n / (SELECT sum(n) FROM c), 8) AS share FROM c QUALIFY rank <= 500""")  # fmt: skip
def vocabulary_budget(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(500)  # the budget; only its rows are ranked in one window
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")).cast("long"))
    return ranked.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("token", "n", "rank", F.round(F.col("n") / F.col("all"), 8).alias("share"))


@register("cell_stats", """
WITH c AS (SELECT l_suppkey AS cell, l_linestatus AS split, count(*) AS n, avg((l_discount > 0.045)::INT) AS acc FROM lineitem GROUP BY ALL)
SELECT cell, split, n, round(acc, 6) AS acc, round(sqrt(acc * (1 - acc) / n), 6) AS sigma, round((acc - 0.5) / sqrt(0.25 / n), 6) AS z, CASE WHEN n < 30 THEN 'too small' WHEN abs((acc - 0.5) / sqrt(0.25 / n)) > 3 THEN 'off' ELSE 'at chance' END AS reading FROM c""")  # fmt: skip
def cell_stats(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_linestatus").alias("split")).agg(F.count("*").alias("n"), F.avg((F.col("l_discount") > 0.045).cast("int")).alias("acc"))
    z = (F.col("acc") - 0.5) / F.sqrt(F.lit(0.25) / F.col("n"))
    reading = F.when(F.col("n") < 30, "too small").when(F.abs(z) > 3, "off").otherwise("at chance")
    return cells.select("cell", "split", "n", F.round("acc", 6).alias("acc"), F.round(M.binomial_sigma(F.col("acc"), F.col("n")), 6).alias("sigma"), F.round(z, 6).alias("z"), reading.alias("reading"))


@register("paired_gains", """
WITH g AS (SELECT o_custkey AS c, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gain FROM orders), b AS (SELECT c, sum(gain) AS s, count(gain) AS n FROM g WHERE gain IS NOT NULL GROUP BY c), t AS (SELECT sum(s) / sum(n) AS m, sum(n) AS n, count(*) AS k FROM b)
SELECT round(any_value(m), 4) AS mean, round(sqrt(any_value(k / (k - 1)) * sum(pow(s - m * b.n, 2))) / any_value(t.n), 4) AS se, any_value(t.n)::BIGINT AS n, any_value(k) AS clusters FROM b, t""")  # fmt: skip
def paired_gains(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    gains = table(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(by)).alias("gain"))
    return M.cluster_mean_se(gains, "gain", "o_custkey").withColumns({"mean": F.round("mean", 4), "se": F.round("se", 4)})


@register("popularity_bins", "SELECT CASE WHEN x < 2 THEN '<2' WHEN x < 3 THEN '2-3' WHEN x < 4 THEN '3-4' ELSE '>=4' END AS bin, count(*) AS n FROM (SELECT log10(greatest(n_chars, 1)) AS x FROM documents) GROUP BY 1")
def popularity_bins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(T.log_bin(F.col("n_chars").cast("double")).alias("bin")).agg(F.count("*").alias("n"))


_NEXT = f"SELECT a.item_id, {TOKENS.format('a.text')} AS a, {TOKENS.format('b.text')} AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


@register("context_room", f"""
SELECT item_id, coalesce(list_position([a[i] IS NOT DISTINCT FROM b[i] for i in range(1, least(len(a), len(b)) + 1)], false), 1) - 1 AS diverge, CASE WHEN 40 - len(b) > 0 AND len(a) > 40 - len(b) THEN array_to_string(a[len(a) - (40 - len(b)) + 1:], ' ') ELSE array_to_string(a, ' ') END AS context FROM ({_NEXT})""")  # fmt: skip
def context_room(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text")).alias("a"))
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    a, b = F.col("a"), F.col("b")
    return pairs.select("item_id", R.first_divergence(a, b).alias("diverge"), F.array_join(T.room_left(a, b, 40), " ").alias("context"))


_STOPS = ["\n\n", ". "]


@register("generated_answers", r"""
WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+', '') AS t, replace(coalesce(text, ''), ',', '') AS f FROM conversations)
SELECT conv_id, turn, length(string_split(string_split(t, chr(10) || chr(10))[1], '. ')[1])::INT AS cut, coalesce(regexp_extract_all(f, '-?\d+(?:\.\d+)?')[-1], trim(f)) AS number, starts_with(lower(t), 'i do not know') AS abstained FROM c""")  # fmt: skip
def generated_answers(spark: SparkSession, sf: str) -> DataFrame:
    said = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.length(T.cut_at_stop(said, _STOPS)).alias("cut"), T.last_number(said).alias("number"), T.is_abstention(said, ["I do not know."]).alias("abstained"))

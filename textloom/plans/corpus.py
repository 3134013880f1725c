"""Queries that mix, split, render, encode, window and pack the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.functions import text as T
from textloom.operators import chat, evidence, mixing, tokens
from textloom.plans.registry import register
from textloom.storage import table
from textloom.streaming import events as streams

TOKENS = "list_filter(string_split(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"
DOC_TOKENS = TOKENS.format("text")
DRAW = "(('0x' || substr(sha1({0}), 1, 8))::BIGINT / 4294967296.0)"
#: Weights of the mix: later sources weigh more.
WEIGHTS = {f"src{i}": float(1 + i % 4) for i in range(20)}
TARGET = 100_000
_WEIGHT = "(1 + substr(source, 4)::INT % 4)::DOUBLE"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, text, tokens and n_tokens."""
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "text", T.tokens(F.col("text")).alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", T.n_tokens(F.col("text")).alias("n_tokens"))


_LEN = f"SELECT doc_id, source, len({DOC_TOKENS}) AS n_tokens FROM documents"


@register("mix_report", f"""
WITH d AS ({_LEN}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1('42:' || doc_id), doc_id) AS k FROM d WHERE n_tokens > 0),
m AS (SELECT *, sum(n_tokens) OVER (ORDER BY (k - 0.5) / {_WEIGHT}, source ROWS UNBOUNDED PRECEDING) AS running FROM r)
SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, round(sum(n_tokens) / sum(sum(n_tokens)) OVER (), 6) AS share FROM m WHERE running - n_tokens < {TARGET} GROUP BY source""")  # fmt: skip
def mix_report(spark: SparkSession, sf: str) -> DataFrame:
    got = mixing.weighted_mix(lengths(spark, sf), WEIGHTS, TARGET).groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    return got.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))


@register("proportional_order", """
WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, k, row_number() OVER (ORDER BY (k - 0.5) / n, source) AS position FROM k""")  # fmt: skip
def proportional_order(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.proportional_order(table(spark, sf, "documents").select("doc_id", "source")).select("doc_id", "source", "k", "position")


@register("order_prefix_replay", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM ({_LEN})),
r AS (SELECT *, sum(n_tokens) OVER (ORDER BY (k - 0.5) / n, source ROWS UNBOUNDED PRECEDING) AS running FROM k)
SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, max(k) AS last_k FROM r WHERE running - n_tokens < {TARGET} GROUP BY source""")  # fmt: skip
def order_prefix_replay(spark: SparkSession, sf: str) -> DataFrame:
    ordered = mixing.proportional_order(lengths(spark, sf)).withColumnRenamed("position", "at")
    summed = mixing.running_total(ordered, F.floor(F.col("share") * 1024), [F.col("share"), F.col("source")], F.col("n_tokens"))
    return mixing.cut(summed, "running", "n_tokens", TARGET, inclusive=True).groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("k").cast("long").alias("last_k"))


@register("replay_passes", f"""
WITH p AS (SELECT d.*, p.pass FROM ({_LEN}) d, (SELECT unnest([1, 2, 3]) AS pass) p WHERE n_tokens > 0),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY pass, sha1('42:' || pass || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS running FROM p)
SELECT source, pass, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM r WHERE running <= 40000 GROUP BY ALL""")  # fmt: skip
def replay_passes(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.replay_passes(lengths(spark, sf), 40_000, 3).groupBy("source", "pass").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


@register("tail_split", f"""
WITH o AS (SELECT *, sum(n_tokens) OVER w - n_tokens AS b, sum(n_tokens) OVER (PARTITION BY source) AS t, row_number() OVER w AS k, count(*) OVER (PARTITION BY source) AS n
           FROM ({_LEN}) WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, CASE WHEN (b >= t - 1000 OR k = n) AND k > 1 THEN 'val' ELSE 'train' END AS split FROM o""")  # fmt: skip
def tail_split(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.tail_split(lengths(spark, sf), 1000).select("doc_id", "source", "split")


@register("holdout_exclusion", """
SELECT doc_id, substr(sha1(text), 1, 16) AS hash FROM documents WHERE substr(sha1(text), 1, 16) NOT IN (SELECT substr(sha1(text), 1, 16) FROM documents WHERE source IN ('src0', 'src1'))""")  # fmt: skip
def holdout_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", T.content_hash(F.col("text")).alias("hash"))
    return mixing.exclude_seen(docs, docs.where(F.col("source").isin("src0", "src1")), "hash").select("doc_id", "hash")


@register("hash_validation_split", f"SELECT source, count(*) AS docs, count(*) FILTER ({DRAW.format("'7:' || source || ':' || doc_id")} < 0.05) AS val FROM documents GROUP BY source")
def hash_validation_split(spark: SparkSession, sf: str) -> DataFrame:
    held = T.draw(7, F.col("source"), F.col("doc_id")) < 0.05
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(held).alias("val"))


@register("sample_per_source", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha1('42:' || doc_id), doc_id) <= 7")
def sample_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 7)


@register("seeded_head", "SELECT doc_id FROM documents ORDER BY sha1('42:' || doc_id), doc_id LIMIT 50")
def seeded_head(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").orderBy(T.order_key(42, F.col("doc_id")), "doc_id").limit(50)


@register("weighted_condition", f"SELECT doc_id, CASE WHEN u < 0.5 THEN 'gold' WHEN u < 0.7 THEN 'mixed' WHEN u < 0.9 THEN 'distractors' ELSE 'none' END AS condition FROM (SELECT doc_id, {DRAW.format("'42:' || doc_id")} AS u FROM documents)")
def weighted_condition(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", mixing.weighted_choice(T.draw(42, F.col("doc_id")), {"gold": 0.5, "mixed": 0.2, "distractors": 0.2, "none": 0.1}).alias("condition"))


@register("prior_use_exclusion", "SELECT d.source, count(*) AS left_over FROM documents d JOIN (SELECT source, min(doc_id) + 400 AS cursor FROM documents GROUP BY source) c USING (source) WHERE doc_id >= cursor GROUP BY d.source")
def prior_use_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    cursor = docs.groupBy("source").agg((F.min("doc_id") + 400).alias("cursor"))
    return docs.join(cursor, "source").where("doc_id >= cursor").groupBy("source").agg(F.count("*").alias("left_over"))


@register("first_by_text", "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def first_by_text(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.first_by_text(table(spark, sf, "documents").select("doc_id", "text"))


@register("drop_reasons", f"""
SELECT coalesce(source, 'all') AS source, reason, count(*) AS n FROM (SELECT source, CASE WHEN n_tokens = 0 THEN 'empty' WHEN n_tokens > 1000 THEN 'too long' WHEN n_tokens < 16 THEN 'too short' ELSE 'kept' END AS reason FROM ({_LEN}))
GROUP BY GROUPING SETS ((source, reason), (reason))""")  # fmt: skip
def drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_tokens")
    reason = F.when(n == 0, "empty").when(n > 1000, "too long").when(n < 16, "too short").otherwise("kept")
    marked = lengths(spark, sf).select("source", reason.alias("reason"))
    return marked.groupingSets([["source", "reason"], ["reason"]], "source", "reason").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), "reason", "n")


@register("fertility", f"SELECT coalesce(source, 'all') AS source, sum(len({DOC_TOKENS}))::BIGINT AS tokens, sum(strlen(text))::BIGINT AS bytes, round(sum(len({DOC_TOKENS})) / sum(strlen(text)), 6) AS fertility FROM documents GROUP BY ROLLUP (source)")
def fertility(spark: SparkSession, sf: str) -> DataFrame:
    sized = table(spark, sf, "documents").select("source", T.n_tokens(F.col("text")).alias("t"), F.octet_length("text").alias("b"))
    got = sized.rollup("source").agg(F.sum("t").alias("tokens"), F.sum("b").alias("bytes"))
    return got.select(F.coalesce("source", F.lit("all")).alias("source"), "tokens", "bytes", F.round(F.col("tokens") / F.col("bytes"), 6).alias("fertility"))


@register("token_histogram", f"SELECT token, count(*) AS n FROM (SELECT unnest({DOC_TOKENS}) AS token FROM documents) GROUP BY token")
def token_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@register("fixed_windows", f"""
WITH d AS (SELECT doc_id, {DOC_TOKENS} AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, len(t), 64)) AS start FROM d)
SELECT doc_id, (start // 64)::INT AS "window", start::INT AS start, len(t[start + 1:start + 64])::INT AS n, sha1(array_to_string(t[start + 1:start + 64], ' ')) AS digest FROM w WHERE len(t) - start >= 32""")  # fmt: skip
def fixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.windows(documents(spark, sf), 64, 32).select("doc_id", "window", "start", F.size("tokens").alias("n"), F.sha1(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@register("framed_windows", f"""
WITH d AS (SELECT doc_id, {DOC_TOKENS} AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, len(t), 64)) AS start FROM d)
SELECT doc_id, count(*) AS windows, sum(len(t[start + 1:start + 64]) + 2)::BIGINT AS n_ids, sum(len(t[start + 1:start + 64]) + 1)::BIGINT AS n_supervised FROM w WHERE len(t) - start >= 32 GROUP BY doc_id""")  # fmt: skip
def framed_windows(spark: SparkSession, sf: str) -> DataFrame:
    framed = tokens.windows(documents(spark, sf), 64, 32).select("doc_id", tokens.framed(F.col("tokens")).alias("x"))
    return framed.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.size("x.ids")).alias("n_ids"), F.sum(F.aggregate("x.mask", F.lit(0), lambda a, m: a + m)).alias("n_supervised"))


@register("three_way_split", f"""
WITH d AS (SELECT doc_id, ({DOC_TOKENS})[1:512] AS t FROM documents), s AS (SELECT doc_id, t, len(t) // 4 AS p FROM d)
SELECT doc_id, p::INT AS n_prefix, len(t[p + 1:p + 96])::INT AS n_held, len(t[p + 97:])::INT AS n_rest,
       len(list_filter([len(t[p + 1 + i:least(p + i + 40, p + 96)]) for i in range(0, 96, 40)], lambda n: n >= 16))::INT AS n_chunks
FROM s WHERE len(t[p + 97:]) >= 32""")  # fmt: skip
def three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    got = documents(spark, sf).select("doc_id", tokens.three_way_split(F.col("tokens"), 512, 96, 40).alias("x")).where("x is not null")
    return got.select("doc_id", *(F.size(f"x.{c}").alias(f"n_{c}") for c in ("prefix", "held", "rest", "chunks")))


@register("verbatim_overlap", f"""
WITH c AS (SELECT item_id, {DOC_TOKENS} AS t FROM benchmark), d AS (SELECT {DOC_TOKENS} AS t FROM documents),
g AS (SELECT DISTINCT array_to_string(t[i + 1:i + 8], ' ') AS g FROM (SELECT t, unnest(range(0, len(t) - 7)) AS i FROM d)),
h AS (SELECT DISTINCT item_id, unnest(range(i, i + 8)) AS p FROM (SELECT item_id, i, array_to_string(t[i + 1:i + 8], ' ') AS g FROM (SELECT item_id, t, unnest(range(0, len(t) - 7, 4)) AS i FROM c)) SEMI JOIN g USING (g))
SELECT item_id, len(t)::INT AS n_tokens, (SELECT count(*) FROM h WHERE h.item_id = c.item_id) AS covered FROM c""")  # fmt: skip
def verbatim_overlap(spark: SparkSession, sf: str) -> DataFrame:
    clean = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text")).alias("tokens"))
    return tokens.overlap_share(clean, documents(spark, sf).select("tokens"), 8, 4, "item_id")


@register("sequence_counts", f"""
WITH p AS (SELECT DISTINCT array_to_string(({DOC_TOKENS})[1:n], ' ') AS pattern, n FROM benchmark, (SELECT unnest([1, 2, 3]) AS n)),
d AS (SELECT {DOC_TOKENS} AS t FROM documents),
g AS (SELECT array_to_string(t[i + 1:i + n], ' ') AS pattern, count(*) AS n FROM (SELECT t, n, unnest(range(0, len(t) - n + 1)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS n)) GROUP BY 1)
SELECT pattern, coalesce(g.n, 0) AS n FROM p LEFT JOIN g USING (pattern)""")  # fmt: skip
def sequence_counts(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "benchmark").select(T.tokens(F.col("text")).alias("t"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n"))
    patterns = first.select(F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("pattern")).distinct()
    return tokens.sequence_counts(documents(spark, sf).select("tokens"), patterns)


@register("repeated_ngram", f"""
SELECT doc_id, len(g) <> len(list_distinct(g)) AS repeated FROM (SELECT doc_id, [array_to_string(t[i + 1:i + 4], chr(31)) for i in range(0, len(t) - 3)] AS g FROM (SELECT doc_id, {DOC_TOKENS} AS t FROM documents))""")  # fmt: skip
def repeated_ngram(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", T.has_repeated_ngram(F.col("tokens"), 4).alias("repeated"))


@register("row_estimate", f"SELECT doc_id % 8 AS shard, ((sum(n_tokens + 1) // 1024) + 1)::BIGINT AS rows FROM ({_LEN}) GROUP BY 1")
def row_estimate(spark: SparkSession, sf: str) -> DataFrame:
    got = lengths(spark, sf).groupBy(F.pmod("doc_id", F.lit(8)).alias("shard")).agg(F.sum(F.col("n_tokens") + 1).alias("t"))
    return got.select("shard", (F.floor(F.col("t") / 1024) + 1).alias("rows"))


_TURNS = "SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IS NOT NULL AND regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> ''"


@register("chat_render", f"SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM ({_TURNS}) GROUP BY conv_id")
def chat_render(spark: SparkSession, sf: str) -> DataFrame:
    return chat.conversations(table(spark, sf, "conversations")).select("conv_id", chat.rendered(F.col("turns")).alias("text")).where("text <> ''")


@register("chat_encode", f"""
SELECT conv_id, (1 + sum(1 + n + a))::BIGINT AS n_ids, sum(CASE WHEN a = 1 THEN n + 1 ELSE 0 END)::BIGINT AS n_supervised
FROM (SELECT conv_id, role, len({DOC_TOKENS}) AS n, (role = 'assistant')::INT AS a FROM ({_TURNS})) GROUP BY conv_id HAVING bool_and(role IN ('system', 'user', 'assistant')) AND bool_or(role = 'assistant')""")  # fmt: skip
def chat_encode(spark: SparkSession, sf: str) -> DataFrame:
    got = chat.conversations(table(spark, sf, "conversations")).where(chat.valid(F.col("turns"))).select("conv_id", chat.encoded(F.col("turns")).alias("x"))
    return got.select("conv_id", F.size("x").cast("long").alias("n_ids"), F.aggregate("x", F.lit(0).cast("long"), lambda a, t: a + t["mask"]).alias("n_supervised"))


@register("normalized_answers", """
SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM benchmark""")  # fmt: skip
def normalized_answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.normalize_answer(F.col("text")).alias("answer"))


_SEP = r"[^\pL\pN\pM_]"
#: Characters between words are doubled, so that every word has a border of its own on both sides, and made single again.
_SWAP = f"(?i)(^|{_SEP}){{0}}($|{_SEP})"


@register("swapped_aliases", f"""
WITH d AS (SELECT item_id, regexp_replace(text, '({_SEP})', '\\1\\1', 'g') AS t FROM benchmark), a AS (SELECT item_id, len(regexp_extract_all(t, '{_SWAP.format('there')}')) AS n, regexp_replace(t, '{_SWAP.format('there')}', '\\1XQ1\\2', 'g') AS t FROM d),
b AS (SELECT item_id, n + len(regexp_extract_all(t, '{_SWAP.format('the')}')) AS n, regexp_replace(t, '{_SWAP.format('the')}', '\\1XQ1\\2', 'g') AS t FROM a)
SELECT item_id, replace(regexp_replace(t, '({_SEP}){_SEP}', '\\1', 'g'), 'XQ1', 'X$1') AS text, n::INT AS n FROM b""")  # fmt: skip
def swapped_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.swapped_with_count(F.col("text"), ["the", "there"], "X$1").alias("x")).select("item_id", "x.text", "x.n")


@register("fixed_conditions", f"""
WITH q AS (SELECT item_id AS qid, len({DOC_TOKENS}) AS n FROM benchmark), c AS (SELECT qid, n, unnest(['gold', 'mixed', 'distractors', 'none']) AS condition FROM q)
SELECT qid, condition FROM c QUALIFY bool_and(n + CASE WHEN condition IN ('gold', 'mixed') THEN 20 ELSE 0 END <= 60) OVER (PARTITION BY qid)""")  # fmt: skip
def fixed_conditions(spark: SparkSession, sf: str) -> DataFrame:
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.n_tokens(F.col("text")).alias("n"))
    return evidence.fixed_groups(questions, F.col("n") + F.when(F.col("condition").isin("gold", "mixed"), 20).otherwise(0) <= 60).select("qid", "condition")


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.windowed_counts(table(spark, sf, "events"))


@register("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")  # fmt: skip
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(table(spark, sf, "events"))

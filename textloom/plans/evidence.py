"""Queries of evidence conditions, chunk stores, edits and substitutes, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import entities as E, text as T
from textloom.operators import evidence as V, mixing, stores as S, tokens, vectors
from textloom.plans import renders as Q
from textloom.plans.corpus import DOC_TOKENS, DRAW, documents
from textloom.plans.evaluation import keys
from textloom.plans.registry import ORACLES, register
from textloom.storage import table

# --- conditions

_U = lambda what: DRAW.format(f"'{what}:' || qid")
_WHICH = {"gold": 0.25, "mixed": 0.25, "many": 0.2, "distractors": 0.2, "none": 0.1}
_COND = f"CASE WHEN {_U('3')} < 0.25 THEN 'gold' WHEN {_U('3')} < 0.5 THEN 'mixed' WHEN {_U('3')} < 0.7 THEN 'many' WHEN {_U('3')} < 0.9 THEN 'distractors' ELSE 'none' END"
_ASKED = f"SELECT *, {_COND} AS condition, CASE condition WHEN 'mixed' THEN 3 WHEN 'many' THEN 4 + floor({DRAW.format("'42:many:' || qid")} * 3) WHEN 'distractors' THEN 3 ELSE 0 END::INT AS k FROM (SELECT item_id AS qid, CASE WHEN item_id % 7 = 0 THEN '' ELSE substr(text, 1, 20) END AS answer, [text] AS gold, CASE WHEN item_id % 2 = 0 THEN ['near ' || item_id, 'by ' || item_id] ELSE [] END AS near, item_id % 11 = 0 AS lm FROM benchmark)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with gold, near texts, an answer that some lack, and a condition each."""
    i = F.col("item_id")
    near = F.when(i % 2 == 0, F.array(F.concat(F.lit("near "), i.cast("string")), F.concat(F.lit("by "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "benchmark").select(i.alias("qid"), F.when(i % 7 == 0, "").otherwise(F.substring("text", 1, 20)).alias("answer"), F.array("text").alias("gold"), near.alias("near"), (i % 11 == 0).alias("lm"), mixing.weighted_choice(T.draw(3, i), _WHICH).alias("condition"))


_RING = "SELECT text, row_number() OVER (ORDER BY sha1('42:' || text)) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT text FROM benchmark)"
_ATTACHED = f"""
WITH q AS ({_ASKED}), t AS (SELECT *, [x.t for x in list_sort([{{'h': sha1('42:' || qid || ':' || n), 't': n}} for n in near])][1:k] AS taken FROM q),
w AS (SELECT qid, k, gold, taken, unnest(range(0, least((SELECT any_value(size) FROM ({_RING})), k + len(gold) + len(taken)))) AS step FROM t),
m AS (SELECT w.qid, w.step, r.text FROM w JOIN ({_RING}) r ON r.place = (floor({DRAW.format("'42:' || qid")} * r.size)::BIGINT + step) % r.size WHERE NOT list_contains(gold, r.text)),
d AS (SELECT t.qid, coalesce(list(m.text ORDER BY step) FILTER (m.text IS NOT NULL), [])[1:greatest(any_value(k) - any_value(len(taken)), 0)] AS drawn FROM t LEFT JOIN m USING (qid) GROUP BY t.qid),
b AS (SELECT *, [{{'t': x, 'g': true}} for x in gold] AS gs, [{{'t': x, 'g': false}} for x in list_concat(taken, drawn)] AS os FROM t JOIN d USING (qid)),
c AS (SELECT *, CASE WHEN condition = 'gold' THEN gs WHEN condition IN ('mixed', 'many') THEN [{{'t': s.t, 'g': s.g}} for s in list_sort([{{'h': sha1('42:' || qid || ':' || x.t), 'g': x.g, 't': x.t}} for x in list_concat(gs, os)])] WHEN condition = 'distractors' THEN os ELSE [] END AS chunks, lm OR (condition IN ('gold', 'mixed', 'many') AND answer <> '') AS answerable FROM b)"""


@register("condition_rows", _ATTACHED + f"""
SELECT qid, condition, len(chunks)::INT AS n, array_to_string([x.g::INT::VARCHAR for x in chunks], '') AS flags, sha1(array_to_string([x.t for x in chunks], '|')) AS digest, CASE WHEN answerable THEN answer ELSE {["I cannot answer from this.", "The passages do not say.", "No answer is given here."]}[floor({DRAW.format("'42:' || qid")} * 3)::INT + 1] END AS target, answerable FROM c""")  # fmt: skip
def condition_rows(spark: SparkSession, sf: str) -> DataFrame:
    made = V.attached(asked(spark, sf), table(spark, sf, "benchmark"), 3, many=(4, 6))
    flags = F.array_join(F.transform("chunks", lambda c: c["gold"].cast("int").cast("string")), "")
    return made.select("qid", "condition", F.size("chunks").alias("n"), flags.alias("flags"), F.sha1(F.array_join(F.transform("chunks", lambda c: c["text"]), "|").cast("binary")).alias("digest"), "target", "answerable")


@register("condition_counters", _ATTACHED + """
SELECT answerable, count(*) FILTER (condition = 'gold') AS gold, count(*) FILTER (condition = 'mixed') AS mixed, count(*) FILTER (condition = 'many') AS many, count(*) FILTER (condition = 'distractors') AS distractors, count(*) FILTER (condition = 'none') AS "none" FROM c WHERE condition = 'none' OR len(chunks) > 0 GROUP BY answerable""")  # fmt: skip
def condition_counters(spark: SparkSession, sf: str) -> DataFrame:
    made = V.attached(asked(spark, sf), table(spark, sf, "benchmark"), 3, many=(4, 6))
    kept = made.where(V.consistent(F.col("condition"), F.col("chunks")))
    return kept.groupBy("answerable").pivot("condition", list(V.CONDITIONS)).count().fillna(0)


@register("capped_chunks", _ATTACHED + """
SELECT qid, array_to_string([x.g::INT::VARCHAR for x in list_filter(chunks, lambda x, i: x.g OR len(list_filter(chunks[1:i], lambda y: NOT y.g)) <= greatest(2 - len(list_filter(chunks, lambda y: y.g)), 0))], '') AS flags FROM c""")  # fmt: skip
def capped_chunks(spark: SparkSession, sf: str) -> DataFrame:
    made = V.attached(asked(spark, sf), table(spark, sf, "benchmark"), 3, many=(4, 6))
    return made.select("qid", F.array_join(F.transform(mixing.cap_chunks(F.col("chunks"), 2), lambda c: c["gold"].cast("int").cast("string")), "").alias("flags"))


@register("evidence_corpus", f"""
WITH d AS (SELECT doc_id AS qid, source, len({DOC_TOKENS}) AS n, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS answer FROM documents WHERE len({DOC_TOKENS}) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1('42:' || qid), qid) AS k FROM d), m AS (SELECT *, sum(n) OVER (ORDER BY (k - 0.5) / (1 + substr(source, 4)::INT % 4), source ROWS UNBOUNDED PRECEDING) AS running FROM r),
c AS (SELECT *, {_COND} AS condition, {DRAW.format("'7:' || source || ':' || qid")} < 0.1 AS val FROM m WHERE running - n < 60000)
SELECT condition, CASE WHEN val THEN 'val' ELSE 'train' END AS split, count(*) AS docs, sum(n)::BIGINT AS tokens, count(*) FILTER (condition IN ('gold', 'mixed', 'many') AND answer <> '') AS answerable FROM c GROUP BY ALL""")  # fmt: skip
def evidence_corpus(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", "source", "lang", F.substring("text", 1, 50).alias("text"), "n_tokens")
    mixed = mixing.weighted_mix(rows, {f"src{i}": float(1 + i % 4) for i in range(20)}, 60_000)
    qid = F.col("doc_id")
    questions = mixed.select(qid.alias("qid"), "source", "n_tokens", F.when(qid % 4 == 0, "").otherwise(F.col("lang")).alias("answer"), F.array("text").alias("gold"), F.array().cast("array<string>").alias("near"), F.lit(False).alias("lm"), mixing.weighted_choice(T.draw(3, qid), _WHICH).alias("condition"))
    made = V.attached(questions, rows, 3).join(questions.select("qid", "source", "n_tokens"), "qid")
    split = F.when(T.draw(7, F.col("source"), F.col("qid")) < 0.1, "val").otherwise("train")
    return made.groupBy("condition", split.alias("split")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.count_if("answerable").alias("answerable"))


# --- stores

_CHUNKS = f"""SELECT substr(source, 4)::INT AS rank, source, doc_id, i // 40 AS chunk, array_to_string(t[i + 1:i + 40], ' ') AS text FROM (SELECT doc_id, source, t, unnest(range(0, len(t), 40)) AS i FROM (SELECT doc_id, source, {DOC_TOKENS} AS t FROM documents))"""
_STORE = f"""c AS ({_CHUNKS}), o AS (SELECT text, min((rank, doc_id, chunk, source)) AS own FROM c GROUP BY text), s AS (SELECT text, own, row_number() OVER (ORDER BY own) - 1 AS chunk_id FROM o),
h AS (SELECT DISTINCT c.source, c.doc_id, s.chunk_id, s.text FROM c JOIN s USING (text))"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    cut = tokens.windows(documents(spark, sf).select("doc_id", "tokens"), 40, 1).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return cut.select(F.substring("source", 4, 9).cast("int").alias("rank"), "source", "doc_id", F.col("window").alias("chunk"), F.array_join("tokens", " ").alias("text"))


@register("store_chunks", f"WITH {_STORE} SELECT chunk_id, sha1(text) AS text, own[4] AS source, own[2] AS doc_id FROM s")
def store_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.store_chunks(_chunks(spark, sf))[0].select("chunk_id", F.sha1(F.col("text").cast("binary")).alias("text"), "source", "doc_id")


_PAD = "' ' || array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') || ' '"


@register("gold_labels", f"""
WITH {_STORE}, q AS (SELECT doc_id AS qid, source, CASE WHEN doc_id % 2 = 0 THEN 'answer' ELSE 'all' END AS mode, split_part(text, ' ', 3) AS answer, doc_id FROM documents WHERE doc_id % 3 = 0),
g AS (SELECT DISTINCT q.qid, h.chunk_id FROM q JOIN h ON h.source = q.source AND h.doc_id = q.doc_id WHERE mode = 'all' OR (trim({_PAD.format('answer')}) <> '' AND contains({_PAD.format('h.text')}, {_PAD.format('answer')})))
SELECT qid, array_to_string(list(chunk_id ORDER BY chunk_id), ',') AS gold, 1 AS groups FROM g GROUP BY qid""")  # fmt: skip
def gold_labels(spark: SparkSession, sf: str) -> DataFrame:
    chunks, held = S.store_chunks(_chunks(spark, sf))
    i = F.col("doc_id")
    questions = table(spark, sf, "documents").where(i % 3 == 0).select(i.alias("qid"), "source", F.when(i % 2 == 0, "answer").otherwise("all").alias("mode"), F.array(F.coalesce(F.get(F.split("text", " "), F.lit(2)), F.lit(""))).alias("answers"), F.array(F.array(i)).alias("gold_docs"))
    return S.gold_labels(questions, chunks, held).select("qid", F.array_join(F.transform("gold_chunk_ids", lambda c: c.cast("string")), ",").alias("gold"), F.size("gold_groups").alias("groups"))


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"
_NEAR = f"SELECT DISTINCT a.vec_id // 10 AS qid, b.vec_id AS id FROM embeddings a JOIN embeddings b ON {_COS} >= 0.3 WHERE a.vec_id % 10 < 2 AND a.vec_id % 3 > 0 AND NOT (b.vec_id // 10 = a.vec_id // 10 AND b.vec_id % 10 < 2 AND b.vec_id % 3 > 0)"
_GOLDS = "SELECT vec_id // 10 AS qid, vec_id AS id FROM embeddings WHERE vec_id % 10 < 2 AND vec_id % 3 > 0"


def _golds(spark: SparkSession, sf: str) -> DataFrame:
    return keys(spark, sf).where("id % 10 < 2 AND id % 3 > 0").select(F.floor(F.col("id") / 10).alias("qid"), "id")


@register("threshold_join", _NEAR)
def threshold_join(spark: SparkSession, sf: str) -> DataFrame:
    return S.near_any(_golds(spark, sf), keys(spark, sf).select("id", "vec"), 0.3)


_CLAIMS = f"""
w AS (SELECT * FROM ({_GOLDS}) UNION SELECT * FROM ({_NEAR})), o AS (SELECT qid, list(id) AS ids, row_number() OVER (ORDER BY sha1('42:' || qid), qid) AS k FROM w GROUP BY qid),
g AS (SELECT k, qid, true AS won, ids AS claimed FROM o WHERE k = 1 UNION ALL SELECT o.k, o.qid, NOT list_has_any(g.claimed, o.ids), CASE WHEN list_has_any(g.claimed, o.ids) THEN g.claimed ELSE list_concat(g.claimed, o.ids) END FROM g JOIN o ON o.k = g.k + 1)"""


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    golds = _golds(spark, sf)
    return golds.unionByName(S.near_any(golds, keys(spark, sf).select("id", "vec"), 0.3)).distinct()


@register("exclusive_claims", f"WITH RECURSIVE {_CLAIMS} SELECT qid FROM g WHERE won")
def exclusive_claims(spark: SparkSession, sf: str) -> DataFrame:
    return S.exclusive_claims(_wanted(spark, sf))


@register("edit_store", f"""
WITH RECURSIVE {_CLAIMS}, p AS (SELECT qid, {DRAW.format("'42:edit:' || qid")} < 0.5 AS edit FROM g WHERE won), r AS (SELECT DISTINCT w.id FROM w JOIN p USING (qid) WHERE NOT edit), e AS (SELECT DISTINCT w.id FROM w JOIN p USING (qid) WHERE edit)
SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id, vec_id IN (SELECT id FROM e) AS edited FROM embeddings WHERE vec_id NOT IN (SELECT id FROM r)""")  # fmt: skip
def edit_store(spark: SparkSession, sf: str) -> DataFrame:
    wanted = _wanted(spark, sf)
    plans = S.exclusive_claims(wanted).withColumn("edit", T.draw(42, F.lit("edit"), F.col("qid")) < 0.5)
    touched = wanted.join(plans, "qid").groupBy(F.col("id").alias("chunk_id")).agg(F.bool_or("edit").alias("edited"))
    left = keys(spark, sf).select(F.col("id").alias("chunk_id")).join(touched, "chunk_id", "left").where("edited IS NULL OR edited")
    return S.dense(left).join(left.select("chunk_id", F.coalesce("edited", F.lit(False)).alias("edited")), "chunk_id")


@register("store_problems", "SELECT 'ids leave gaps' AS problem, (max(vec_id) + 1 - count(*))::BIGINT AS n FROM embeddings WHERE vec_id % 9 <> 0 UNION ALL SELECT 'empty texts', count(*) FILTER (vec_id % 5 = 0) FROM embeddings WHERE vec_id % 9 <> 0")
def store_problems(spark: SparkSession, sf: str) -> DataFrame:
    chunks = keys(spark, sf).where("id % 9 <> 0").select(F.col("id").alias("chunk_id"), "vec", F.when(F.col("id") % 5 == 0, "").otherwise("x").alias("text"))
    return S.store_problems(chunks, 64)


@register("stored_copy", "SELECT vec_id AS chunk_id, label FROM embeddings")
def stored_copy(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from textloom.storage import shared_dir

    path = f"{shared_dir(spark)}/textloom-store-{uuid.uuid4().hex}"
    S.write_store(keys(spark, sf).select(F.col("id").alias("chunk_id"), "vec", "label", F.lit("x").alias("text")), path, 64)
    return S.read_store(spark, path, 64).select("chunk_id", "label")


@register("looked_up", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return S.looked_up(people, table(spark, sf, "nation"), "n_nationkey", ["n_name"]).select("c_custkey", "n_name")


@register("candidate_recall", f"""
WITH t AS ({ORACLES['vector_top_k']}) SELECT count(DISTINCT qid) AS n, round(avg((id % 3 > 0)::INT), 6) AS recall FROM t""")  # fmt: skip
def candidate_recall(spark: SparkSession, sf: str) -> DataFrame:
    truth = vectors.top_k(keys(spark, sf).where("id % 20 = 0"), keys(spark, sf), 10)
    return vectors.candidate_recall(truth.where("id % 3 > 0"), truth, 10).withColumn("recall", F.round("recall", 6))


@register("near_and_uniform", f"""
WITH n AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY sha1('42:' || id || ':' || other)) AS r FROM ({ORACLES['neighbours_in_label']}) WHERE id % 10 = 0), s AS (SELECT id, list(other ORDER BY other) AS near FROM n WHERE r <= 3 GROUP BY id),
a AS (SELECT vec_id AS id, coalesce(near, []) AS near FROM embeddings LEFT JOIN s ON s.id = vec_id WHERE vec_id % 10 = 0), g AS (SELECT vec_id AS other, row_number() OVER (ORDER BY sha1('42:' || vec_id), vec_id) AS place, count(*) OVER () AS size FROM embeddings),
w AS (SELECT id, near, unnest(range(0, 6 + len(near))) AS step FROM a), m AS (SELECT w.id, w.near, w.step, g.other FROM w JOIN g ON g.place = (floor({DRAW.format("'42:walk:' || w.id")} * g.size)::BIGINT + step) % g.size + 1 WHERE g.other <> w.id AND NOT list_contains(near, g.other))
SELECT id, array_to_string(list_concat(any_value(near), list(other ORDER BY step)[1:5 - len(any_value(near))]), ',') AS others FROM m GROUP BY id""")  # fmt: skip
def near_and_uniform(spark: SparkSession, sf: str) -> DataFrame:
    own = keys(spark, sf)
    near = vectors.neighbours_in_group(own, "label", 3).select("id", "other")
    found = vectors.near_and_uniform(own.where("id % 10 = 0").select("id"), near.where("id % 10 = 0"), own.select("id"), 5)
    return found.select("id", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


# --- answers

_ANSWERS = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Who wrote it?' WHEN 1 THEN 'What famous city is it?' WHEN 2 THEN 'Which company made it?' WHEN 3 THEN 'Where is it?' WHEN 4 THEN 'What is the prize?' ELSE 'How many are there?' END AS question,
CASE o_orderkey % 14 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'in ' || year(o_orderdate) WHEN 3 THEN (o_custkey % 97) || ' miles' WHEN 4 THEN '$' || o_custkey WHEN 5 THEN 'twenty ' || (['one', 'two', 'six', 'dozen'][o_custkey % 4 + 1]) || ' men'
WHEN 6 THEN 'the House of Lake ' || o_orderstatus WHEN 7 THEN 'Bank of ' || o_orderpriority WHEN 8 THEN 'John ' || o_orderstatus || ' Smith' WHEN 9 THEN 'a plain thing' WHEN 10 THEN ' ' WHEN 11 THEN year(o_orderdate) || 's' WHEN 12 THEN 'Hall in ' || year(o_orderdate) ELSE 'Long Name ' || chr((65 + o_custkey % 26)::INT) || ' Ray' END AS answer FROM orders"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and answers of all types, made from orders."""
    k, c, day, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    asked_ = ["Who wrote it?", "What famous city is it?", "Which company made it?", "Where is it?", "What is the prize?", "How many are there?"]
    year = F.year(day).cast("string")
    said = [
        F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "yyyy-MM-dd"), F.concat(F.lit("in "), year), F.concat((c % 97).cast("string"), F.lit(" miles")), F.concat(F.lit("$"), c.cast("string")),
        F.concat(F.lit("twenty "), F.get(F.array(*map(F.lit, ("one", "two", "six", "dozen"))), (c % 4).cast("int")), F.lit(" men")), F.concat(F.lit("the House of Lake "), status), F.concat(F.lit("Bank of "), "o_orderpriority"),
        F.concat(F.lit("John "), status, F.lit(" Smith")), F.lit("a plain thing"), F.lit(" "), F.concat(year, F.lit("s")), F.concat(F.lit("Hall in "), year), F.concat(F.lit("Long Name "), F.char(65 + c % 26), F.lit(" Ray")),
    ]
    return table(spark, sf, "orders").select(k.alias("id"), F.get(F.array(*map(F.lit, asked_)), (k % 6).cast("int")).alias("question"), F.get(F.array(*said), (k % 14).cast("int")).alias("answer"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_UNIT_SQL = f"""CASE WHEN regexp_matches(s, '{E.NUMBER}') THEN CASE WHEN list_has_any(string_split_regex(trim(regexp_extract(s, '{E.NUMBER}', 1)), '\\s+'), {_list(E.NO_UNITS)}) THEN NULL ELSE trim(regexp_extract(s, '{E.NUMBER}', 1)) END
WHEN list_contains({_list(E.NUMBER_WORDS)}, lower(split_part(s, ' ', 1))) THEN (SELECT CASE WHEN len(u) > 3 OR len(list_filter(u, lambda x: NOT regexp_matches(x, '^[a-z]') OR list_contains({_list(E.NO_UNITS)}, lower(x)))) > 0 THEN NULL ELSE array_to_string(u, ' ') END FROM (SELECT list_filter(string_split_regex(s, '[\\s\\-]+'), lambda x: x <> '' AND NOT list_contains({_list(E.NUMBER_WORDS)}, lower(x))) AS u)) END"""
_STRIP = "regexp_replace(regexp_replace(lower(w), '^[.,]+', ''), '[.,]+$', '')"
_TYPED = f"""
a AS (SELECT *, trim(answer) AS s, regexp_extract(lower(question), '{E.HEAD.replace("'", "''")}', 1) AS head, lower(question) AS q FROM ({_ANSWERS})),
b AS (SELECT *, {_UNIT_SQL} AS unit, CASE WHEN lower(split_part(s, ' ', 1)) = 'the' THEN string_split(s, ' ')[2:] ELSE string_split(s, ' ') END AS words FROM a),
c AS (SELECT *, len(words) <= 8 AND len([i for i in range(1, len(words) + 1) if NOT regexp_matches(words[i], '^[A-Z0-9]') AND NOT (list_contains({_list(E.CONNECTORS)}, lower(words[i])) AND i > 1 AND i < len(words))]) = 0 AND len([w for w in words if regexp_matches(w, '^[A-Z0-9]')]) > 0 AS name, [{_STRIP} for w in words] AS low FROM b),
t AS (SELECT *, CASE WHEN s = '' THEN 'COMMON' WHEN {' OR '.join(f"regexp_matches(s, '{d}')" for d in E.DATES)} THEN 'DATE' WHEN regexp_matches(s, '{E.YEAR}') AND regexp_extract(s, '{E.YEAR}', 1)::INT BETWEEN 1000 AND 2099 THEN 'YEAR' WHEN unit IS NOT NULL THEN 'NUMBER' WHEN NOT name THEN 'COMMON'
 WHEN len([w for w in low if regexp_matches(w, '^[0-9]+$')]) > 0 THEN 'PROPER' WHEN list_contains({_list(E.ORGANIZATIONS)}, head) THEN 'ORGANIZATION' WHEN list_contains({_list(E.LOCATIONS)}, head) THEN 'LOCATION' WHEN list_contains({_list(E.PERSONS)}, head) THEN CASE WHEN len(words) <= 4 THEN 'PERSON' ELSE 'PROPER' END
 WHEN regexp_matches(q, '\\bwhere\\b') THEN 'LOCATION' WHEN regexp_matches(q, '\\bwho(m|se)?\\b') THEN CASE WHEN list_has_any(low, {_list(E.ORGANIZATION_WORDS)}) THEN 'ORGANIZATION' WHEN len(words) <= 4 THEN 'PERSON' ELSE 'PROPER' END
 WHEN list_has_any(low, {_list(E.ORGANIZATION_WORDS)}) THEN 'ORGANIZATION' WHEN list_has_any(low, {_list(E.LOCATION_WORDS)}) THEN 'LOCATION' ELSE 'PROPER' END AS type FROM c),
v AS (SELECT *, CASE WHEN type IN ('LOCATION', 'ORGANIZATION') THEN head WHEN type = 'NUMBER' THEN CASE WHEN contains(s, '%') THEN 'percent' WHEN regexp_matches(s, '^[$£€]') THEN 'currency' WHEN unit <> '' THEN lower(unit) WHEN regexp_matches(s, '[0-9]') THEN 'digits' ELSE 'words' END WHEN type = 'DATE' THEN CASE WHEN regexp_matches(s, '\\b[0-9]{{3,4}}\\b') THEN 'year' ELSE 'noyear' END
 WHEN type = 'YEAR' THEN CASE WHEN ends_with(s, 's') THEN 'decade' ELSE 'year' END WHEN type = 'PROPER' THEN CASE WHEN list_contains({_list(E.VAGUE)}, regexp_extract(q, '{E.FIRST_WORD}', 1)) THEN '' ELSE regexp_extract(q, '{E.FIRST_WORD}', 1) END ELSE '' END AS variant,
 CASE WHEN type = 'YEAR' THEN regexp_extract(s, '{E.YEAR}', 1) || CASE WHEN ends_with(lower(s), 's') THEN 's' ELSE '' END WHEN lower(split_part(s, ' ', 1)) = 'the' THEN substr(s, 5) ELSE s END AS form FROM t)"""


def typed(spark: SparkSession, sf: str) -> DataFrame:
    told = answers(spark, sf).withColumn("type", E.answer_type(F.col("question"), F.col("answer")))
    return told.withColumns({"variant": E.answer_variant(F.col("type"), F.col("question"), F.col("answer")), "form": E.pool_form(F.col("type"), F.col("answer"))})


@register("answer_types", f"WITH {_TYPED} SELECT id, type, variant, form FROM v")
def answer_types(spark: SparkSession, sf: str) -> DataFrame:
    return typed(spark, sf).select("id", "type", "variant", "form")


_NORM = "array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@register("gazetteer", f"""
WITH {_TYPED}, f AS (SELECT type, {_NORM.format('s')} AS norm, arg_min(form, id) AS form, arg_min(variant, id) AS variant FROM v WHERE type <> 'COMMON' AND {_NORM.format('s')} <> '' GROUP BY ALL)
SELECT type, coalesce(variant, 'all') AS variant, count(*) AS n, min(form) AS first FROM f GROUP BY GROUPING SETS ((type, variant), (type))""")  # fmt: skip
def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    pool = pooled(spark, sf)
    by = pool.groupingSets([["type", "variant"], ["type"]], "type", "variant").agg(F.count("*").alias("n"), F.min("form").alias("first"))
    return by.select("type", F.coalesce("variant", F.lit("all")).alias("variant"), "n", "first")


def pooled(spark: SparkSession, sf: str) -> DataFrame:
    """(type, norm, form, variant): the distinct typed answers, each as its first question has it."""
    told = typed(spark, sf).withColumn("norm", T.normalize_answer(F.col("answer"))).where((F.col("type") != "COMMON") & (F.col("norm") != ""))
    return told.groupBy("type", "norm").agg(F.min_by("form", "id").alias("form"), F.min_by("variant", "id").alias("variant"))


#: The same rows in SQL; its join of every answer with every form is too slow for whole tables, so it is a test on small ones.
COUNTERFACTUALS = f"""
WITH {_TYPED}, pool AS (SELECT DISTINCT type, arg_min(variant, id) AS variant, arg_min(form, id) AS form FROM v WHERE type <> 'COMMON' AND {_NORM.format('s')} <> '' GROUP BY type, {_NORM.format('s')}),
k AS (SELECT DISTINCT type || '|' || variant AS pool, form FROM pool WHERE variant <> '' UNION SELECT DISTINCT type, form FROM pool), g AS (SELECT pool, form, row_number() OVER (PARTITION BY pool ORDER BY sha1('42:' || form), form) AS place, count(*) OVER (PARTITION BY pool) AS size FROM k),
q AS (SELECT id AS qid, s, type, variant, 'Here is ' || CASE WHEN id % 5 = 0 THEN 'x' ELSE s END || ', said twice: ' || CASE WHEN id % 5 = 0 THEN 'y' ELSE s END || '.' AS text FROM v WHERE id % 4 = 0),
r AS (SELECT *, CASE WHEN s = '' THEN 'unanswerable' WHEN type = 'COMMON' THEN 'type_not_swappable' WHEN id5 THEN 'answer_not_in_passage' END AS early FROM (SELECT *, qid % 5 = 0 AS id5 FROM q)),
w AS (SELECT r.*, CASE WHEN variant <> '' AND coalesce((SELECT any_value(size) FROM g WHERE g.pool = r.type || '|' || r.variant), 0) >= 20 THEN type || '|' || variant WHEN type NOT IN ('NUMBER', 'PROPER') THEN type END AS pool FROM r WHERE early IS NULL),
m AS (SELECT w.qid, g.form, (g.place - 1 - floor({DRAW.format("w.qid")} * g.size)::BIGINT + g.size) % g.size AS step FROM w JOIN g ON g.pool = w.pool WHERE NOT contains({_NORM.format('w.s')}, {_NORM.format('g.form')}) AND NOT contains({_NORM.format('g.form')}, {_NORM.format('w.s')}) AND NOT regexp_matches(w.text, '(?i)(^|[^\\pL\\pN\\pM_])' || regexp_escape(g.form) || '($|[^\\pL\\pN\\pM_])')),
best AS (SELECT qid, arg_min(form, step) AS form FROM m GROUP BY qid)
SELECT r.qid, coalesce(early, CASE WHEN form IS NULL THEN 'no_substitute' ELSE 'eligible' END) AS reason, CASE WHEN early IS NULL THEN form END AS substitute, CASE WHEN early IS NULL AND form IS NOT NULL THEN 2 END AS n FROM r LEFT JOIN best ON best.qid = r.qid""".replace(DRAW.format("w.qid"), DRAW.format("'42:' || w.qid"))  # fmt: skip


@register("counterfactuals")
def counterfactuals(spark: SparkSession, sf: str) -> DataFrame:
    told = answers(spark, sf).where("id % 4 = 0")
    said = F.trim("answer")
    passage = lambda other: F.when(F.col("id") % 5 == 0, F.lit(other)).otherwise(said)
    text = F.concat(F.lit("Here is "), passage("x"), F.lit(", said twice: "), passage("y"), F.lit("."))
    records = told.select(F.col("id").alias("qid"), "question", F.array(said).alias("references"), text.alias("text"))
    return V.counterfactuals(records, pooled(spark, sf)).select("qid", "reason", "substitute", "n")


@register("recent_draws", f"""
WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents), w AS (SELECT doc_id, source, place, least(place - 1, 6) AS room, unnest(range(0, least(place - 1, 3))) AS step FROM p),
d AS (SELECT w.doc_id, w.step, o.doc_id AS other FROM w JOIN p o ON o.source = w.source AND o.place = w.place - 1 - (floor({DRAW.format("'42:recent:' || w.doc_id")} * room)::BIGINT + step) % room)
SELECT p.doc_id, coalesce(string_agg(other::VARCHAR, ',' ORDER BY step), '') AS drawn FROM p LEFT JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id""")  # fmt: skip
def recent_draws(spark: SparkSession, sf: str) -> DataFrame:
    found = V.recent(table(spark, sf, "documents"), 3, 6)
    return found.select("doc_id", F.array_join(F.transform("drawn", lambda x: x.cast("string")), ",").alias("drawn"))


@register("unanswerable_sample", f"SELECT item_id FROM benchmark WHERE item_id % 3 > 0 OR {DRAW.format("'8:' || item_id")} < 0.4")
def unanswerable_sample(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf, "benchmark").where((i % 3 > 0) | (T.draw(8, i) < 0.4)).select("item_id")


@register("question_blocks", "WITH r AS (SELECT source, lang AS title, min(doc_id) AS key, count(*) AS n FROM documents GROUP BY ALL) SELECT source, title, key, n, key % 7 = 0 AS gold FROM r")
def question_blocks(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "documents").groupBy("source", F.col("lang").alias("title")).agg(F.min("doc_id").alias("key"), F.count("*").alias("n"))
    return by.withColumn("gold", F.col("key") % 7 == 0)


@register("cached_vectors", "WITH k AS (SELECT text, length(text) AS a, strlen(text) AS b FROM documents GROUP BY text) SELECT doc_id, round(a / sqrt(a * a + b * b), 6) AS first FROM documents JOIN k USING (text) WHERE a + b > 0")
def cached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    embed = lambda texts: texts.withColumn("vec", F.array(F.length("text").cast("double"), F.octet_length("text").cast("double")))
    return vectors.embedded(table(spark, sf, "documents").where("text <> ''").select("doc_id", "text"), embed).select("doc_id", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@register("answer_frequency", f"""
WITH a AS (SELECT item_id, ({DOC_TOKENS})[1] AS t FROM benchmark WHERE len({DOC_TOKENS}) > 0), d AS (SELECT {DOC_TOKENS} AS t FROM documents), o AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM d) GROUP BY w), p AS (SELECT w, count(*) AS n FROM (SELECT t[i] || ' ' || t[i + 1] AS w FROM (SELECT t, unnest(range(1, len(t))) AS i FROM d)) GROUP BY w)
SELECT item_id, coalesce(o.n, 0) + coalesce(p.n, 0) AS n FROM a LEFT JOIN o ON o.w = a.t LEFT JOIN p ON p.w = 'the ' || a.t""")  # fmt: skip
def answer_frequency(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "benchmark").select("item_id", F.get(T.tokens(F.col("text")), F.lit(0)).alias("t")).where("t IS NOT NULL")
    forms = first.select("item_id", F.explode(F.array("t", F.concat(F.lit("the "), "t"))).alias("pattern"))
    counts = tokens.sequence_counts(documents(spark, sf).select("tokens"), forms.select("pattern").distinct())
    return forms.join(counts, "pattern").groupBy("item_id").agg(F.sum("n").alias("n"))


@register("supervised_overlap", f"""
WITH c AS (SELECT item_id, {DOC_TOKENS} AS t FROM benchmark), d AS (SELECT {DOC_TOKENS} AS t FROM documents), g AS (SELECT DISTINCT array_to_string(t[i + 1:i + 8], ' ') AS g FROM (SELECT t, unnest(range(0, len(t) - 7)) AS i FROM d) WHERE i >= len(t) // 3),
h AS (SELECT DISTINCT item_id, unnest(range(i, i + 8)) AS p FROM (SELECT item_id, i, array_to_string(t[i + 1:i + 8], ' ') AS g FROM (SELECT item_id, t, unnest(range(0, len(t) - 7, 4)) AS i FROM c)) SEMI JOIN g USING (g)) SELECT item_id, len(t)::INT AS n_tokens, (SELECT count(*) FROM h WHERE h.item_id = c.item_id) AS covered FROM c""")  # fmt: skip
def supervised_overlap(spark: SparkSession, sf: str) -> DataFrame:
    clean = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text")).alias("tokens"))
    late = F.transform("tokens", lambda _, i: (i >= F.floor(F.size("tokens") / 3)).cast("int"))
    return tokens.overlap_share(clean, documents(spark, sf).select("tokens", late.alias("mask")), 8, 4, "item_id", "mask")


@register("over_row_limit", f"SELECT doc_id, len({DOC_TOKENS}) + 1 + 2 > 512 AS over FROM documents")
def over_row_limit(spark: SparkSession, sf: str) -> DataFrame:
    from textloom.operators.rows import over_limit

    return documents(spark, sf).select("doc_id", over_limit(F.col("tokens"), 512, 2).alias("over"))


@register("light_normalized", "SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS text FROM benchmark")
def light_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.light_normalize(F.col("text")).alias("text"))

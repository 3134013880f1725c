"""Queries of relation chains and of biographies with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators import biographies as B, chains as C, reports as R
from textloom.plans import renders as Q
from textloom.plans.corpus import DRAW
from textloom.plans.registry import register
from textloom.storage import table

RELATIONS = (
    C.Relation("home", "person", "city", "the home of {x}", "What is the home of {x}?"),
    C.Relation("mayor", "city", "person", "the mayor of {x}", "Who is the mayor of {x}?"),
    C.Relation("region", "city", "area", "the region of {x}", "What is the region of {x}?"),
    C.Relation("seat", "area", "city", "the seat of {x}", "What is the seat of {x}?"),
    C.Relation("mentor", "person", "person", "the mentor of {x}", "Who is the mentor of {x}?"),
    C.Relation("river", "area", "water", "the river of {x}", "What is the river of {x}?"),
    C.Relation("source", "water", "area", "the source of {x}", "Where is the source of {x}?"),
)
_REL = "(VALUES " + ", ".join(f"('{r.name}', '{r.domain}', '{r.range}')" for r in RELATIONS) + ") v(name, domain, range)"
_TWO = "t AS (SELECT a.name || '|' || b.name AS pair, a.name AS x, b.name AS y FROM r a JOIN r b ON b.domain = a.range)"
_HELD = f"""r AS (SELECT * FROM {_REL}), {_TWO}, o AS (SELECT n, t.*, row_number() OVER (PARTITION BY n ORDER BY sha1('0:' || n || ':' || pair)) AS k, count(*) OVER (PARTITION BY n) AS c FROM t, (SELECT unnest(range(0, 50)) AS n)),
s AS (SELECT n, pair, x, y, k <= greatest(2, round_even(0.2 * c, 0)::INT) AS held FROM o), ok AS (SELECT n FROM (SELECT n, x AS m, held FROM s UNION ALL SELECT n, y, held FROM s) GROUP BY n HAVING count(DISTINCT m) FILTER (NOT held) = count(DISTINCT m)),
h AS (SELECT pair FROM s WHERE held AND n = (SELECT min(n) FROM ok))"""


def _relations(spark: SparkSession) -> DataFrame:
    return C.relation_table(spark, RELATIONS)


@register("held_out_pairs", f"WITH {_HELD} SELECT pair FROM h")
def held_out_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return C.held_out_pairs(_relations(spark))


@register("seen_compositions", f"WITH {_HELD} SELECT a.name || '|' || b.name || '|' || c.name AS chain FROM r a JOIN r b ON b.domain = a.range JOIN r c ON c.domain = b.range WHERE a.name || '|' || b.name NOT IN (SELECT pair FROM h) AND b.name || '|' || c.name NOT IN (SELECT pair FROM h)")
def seen_compositions(spark: SparkSession, sf: str) -> DataFrame:
    own = _relations(spark)
    return C.seen_compositions(C.compositions(own, 3), C.held_out_pairs(own)).select(F.array_join("chain", "|").alias("chain"))


@register("dealt_questions", f"""
WITH {_HELD}, l AS (SELECT list(pair ORDER BY pair) AS ps FROM h), i AS (SELECT unnest(range(0, 300)) AS id) SELECT split, count(*) AS n, count(*) FILTER (hops = 2) AS two, count(DISTINCT pair) AS pairs FROM (
SELECT 'train' AS split, CASE WHEN {DRAW.format("'42:hops:' || id")} < 0.25 THEN 1 WHEN {DRAW.format("'42:hops:' || id")} < 0.75 THEN 2 ELSE 3 END AS hops, NULL AS pair FROM i UNION ALL SELECT 'eval_' || k, k, NULL FROM i, (SELECT unnest([1, 2, 3]) AS k) UNION ALL SELECT 'held_out', 2, ps[id % len(ps) + 1] FROM i, l) GROUP BY split""")  # fmt: skip
def dealt_questions(spark: SparkSession, sf: str) -> DataFrame:
    held = sorted(r.pair for r in C.held_out_pairs(_relations(spark)).collect())  # a few pairs
    dealt = C.dealt_questions(spark, 300, held, {1: 0.25, 2: 0.5, 3: 0.25})
    return dealt.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("hops") == 2).alias("two"), F.countDistinct("pair").alias("pairs"))


_ENT = lambda slot: f"'E' || substr(sha1('42:' || qid || ':' || {slot}), 1, 10)"
_FACT = lambda s, r, o, kind, hop: f"{{'s': {_ENT(s)}, 'r': {r}, 'o': {_ENT(o)}, 'kind': '{kind}', 'hop': {hop}}}"
_QUESTIONS = f"""
{_HELD}, l AS (SELECT list(ch ORDER BY ch) AS cs FROM (SELECT [a.name, b.name] AS ch FROM r a JOIN r b ON b.domain = a.range)), i AS (SELECT c_custkey AS qid FROM customer), q AS (SELECT qid, cs[floor({DRAW.format("'42:chain:' || qid")} * len(cs))::INT + 1] AS chain FROM i, l),
f AS (SELECT qid, chain, list_concat(list_concat([{_FACT("'e' || j", "chain[j + 1]", "'e' || j + 1", 'gold', 'j + 1')} for j in range(0, 2)], [{_FACT("'d' || j", "chain[j + 1]", "'d' || j + 1", 'C', '0')} for j in range(0, 2)]),
 list_concat(list_concat([{_FACT("'s' || j", "chain[-1]", "'o' || j", 'A', '0')} for j in range(0, 2)], [{_FACT("'f' || j", "'feeds ' || chain[-1]", "'s' || j", 'A', '0')} for j in range(0, 2)]), [{_FACT("'x' || j", "chain[1]", "'y' || j", 'A', '0')} for j in range(0, 2)])) AS facts FROM q),
g AS (SELECT qid, chain, [z.f for z in list_sort([{{'h': sha1('42:' || qid || ':' || x.s || ':' || x.o), 'f': x}} for x in facts])] AS facts, {_ENT("'e0'")} AS start, {_ENT("'e2'")} AS answer FROM f)"""


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    # ids are few bytes and lie in few files, but a question of each is much work
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid")).repartition(max(8, 4 * spark.sparkContext.defaultParallelism))
    return C.questions(ids, C.compositions(_relations(spark), 2), 8)


def _asked(chain: str = "chain") -> F.Column:
    """The question text of a 2-chain, by its relations."""
    found = F.lit(None).cast("string")
    for a in RELATIONS:
        for b in RELATIONS:
            found = F.when((F.get(chain, F.lit(0)) == a.name) & (F.get(chain, F.lit(1)) == b.name), Q.R.chain_question(F.get("entities", F.lit(0)), [a.phrase], b.question)).otherwise(found)
    return found


@register("chain_questions", f"""
WITH {_QUESTIONS} SELECT qid, array_to_string(chain, '|') AS chain, len(facts)::INT AS n, sha1(array_to_string([x.s || x.r || x.o for x in facts], '|')) AS digest, array_to_string(list_distinct([x.o for x in facts if x.r = chain[-1]]), '|') <> '' AS some, answer, true AS valid FROM g""")  # fmt: skip
def chain_questions(spark: SparkSession, sf: str) -> DataFrame:
    made = _questions(spark, sf).withColumn("question", _asked())
    digest = F.sha1(F.array_join(F.transform("facts", lambda f: F.concat(f["s"], f["r"], f["o"])), "|").cast("binary"))
    some = F.size(C.final_objects(F.col("chain"), F.col("facts"))) > 0
    ok = C.valid(F.col("question"), F.col("chain"), F.col("entities"), F.col("facts"))
    told = made.withColumns({"n": F.size("facts"), "digest": digest, "some": some, "answer": F.element_at("entities", -1), "valid": ok})
    return told.select("qid", F.array_join("chain", "|").alias("chain"), "n", "digest", "some", "answer", "valid")


@register("final_objects", f"WITH {_QUESTIONS}, fo AS (SELECT qid, x.o AS o, min(i) AS i FROM (SELECT qid, chain, unnest(facts) AS x, unnest(range(0, len(facts))) AS i FROM g) WHERE x.r = chain[-1] GROUP BY ALL) SELECT qid, string_agg(o, '|' ORDER BY i) AS candidates FROM fo GROUP BY qid")
def final_objects(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("qid", F.array_join(C.final_objects(F.col("chain"), F.col("facts")), "|").alias("candidates"))


@register("shortcut_baselines", f"""
WITH {_QUESTIONS}, c AS (SELECT *, list_distinct([x.o for x in facts if x.r = chain[-1]]) AS cs, [x.o for x in facts if x.r = chain[-1]] AS os, flatten([[x.s, x.o] for x in facts]) AS ns FROM g),
n AS (SELECT *, [{{'c': c, 'n': len([y for y in ns if y = c])}} for c in cs] AS k, [x for x in facts if x.s = start AND list_contains(cs, x.o)] AS named, [x.o for x in facts if x.r = chain[-1] AND len([y for y in ns if y = x.s]) > 1] AS rec, [x.o for x in facts if x.r = chain[-2]] AS feeders FROM c),
p AS (SELECT *, [y.c for y in k if y.n = list_max([z.n for z in k])] AS hi, [y.c for y in k if y.n = list_min([z.n for z in k])] AS lo, list_distinct([x.o for x in facts if x.r = chain[-1] AND list_contains(feeders, x.s)]) AS fed FROM n)
SELECT {', '.join(f"round(avg({e}), 6) AS {a}" for a, e in {
    'frequent': "CASE WHEN list_contains(hi, answer) THEN 1.0 / len(hi) ELSE 0 END", 'infrequent': "CASE WHEN list_contains(lo, answer) THEN 1.0 / len(lo) ELSE 0 END", 'named_subject': "CASE WHEN len(named) > 0 THEN (named[1].o = answer)::INT ELSE 1.0 / len(cs) END",
    'final_object': "CASE WHEN list_contains(os, answer) THEN 1.0 / len(os) ELSE 0 END", 'recurring_subject': "CASE WHEN len(rec) = 0 THEN 1.0 / len(cs) WHEN list_contains(rec, answer) THEN 1.0 / len(rec) ELSE 0 END", 'penultimate_fed': "CASE WHEN len(fed) = 0 THEN 1.0 / len(cs) WHEN list_contains(fed, answer) THEN 1.0 / len(fed) ELSE 0 END", 'random': "1.0 / len(cs)"}.items())} FROM p""")  # fmt: skip
def shortcut_baselines(spark: SparkSession, sf: str) -> DataFrame:
    made = _questions(spark, sf).withColumn("question", _asked())
    facts = F.transform("facts", lambda f: F.struct(f["s"].alias("s"), f["r"].alias("r"), f["o"].alias("o")))
    x = made.select(R.shortcut_pickers(F.col("question"), F.element_at("entities", -1), F.col("chain"), facts).alias("x")).select("x.*")
    return x.agg(*(F.round(F.avg(c), 6).alias(c) for c in x.columns))


FIRST, LAST = ["Ana", "Bo", "Cy", "Di"], ["Ash", "Birch", "Cedar"]


@register("fresh_names", f"""
WITH t AS (SELECT c_custkey AS id, t, {FIRST}[floor({DRAW.format("'42:first:' || c_custkey || ':' || t")} * 4)::INT + 1] || ' ' || {LAST}[floor({DRAW.format("'42:last:' || c_custkey || ':' || t")} * 3)::INT + 1] AS name FROM customer, (SELECT unnest(range(0, 50)) AS t))
SELECT id, arg_min(name, t) AS name FROM t WHERE name NOT IN ('Ana Ash', 'Di Cedar') GROUP BY id""")  # fmt: skip
def fresh_names(spark: SparkSession, sf: str) -> DataFrame:
    taken = spark.createDataFrame([("Ana Ash",), ("Di Cedar",)], "name string")
    return B.fresh_names(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), FIRST, LAST, taken)


@register("build_layout", "WITH b AS (SELECT 'bio' AS kind, c_custkey AS key, unnest(range(0, 1 + c_custkey % 4))::INT AS exposure FROM customer UNION ALL SELECT 'filler', doc_id, 0 FROM documents) SELECT kind, key, exposure, row_number() OVER (ORDER BY sha1('42:' || kind || ':' || key || ':' || exposure)) AS place FROM b")
def build_layout(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (1 + F.col("c_custkey") % 4).alias("tier"))
    return B.layout(people, table(spark, sf, "documents").select(F.col("doc_id").alias("key"))).select("kind", "key", F.col("exposure").cast("int").alias("exposure"), "place")


_DU = lambda what: DRAW.format(f"'42:{what}:' || key || ':' || exposure")
_TRADES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("retrieval_documents", f"""
WITH p AS (SELECT *, unnest(range(0, 1 + key % 2))::INT AS exposure FROM ({Q.PEOPLE})), o AS (SELECT key AS okey, {Q.CARD} AS card FROM ({Q.PEOPLE})), d AS (SELECT p.*, {_DU('gold')} >= 0.3 AS gold, o.card AS beside FROM p JOIN o ON o.okey = CASE WHEN p.key = (SELECT max(okey) FROM o) THEN (SELECT min(okey) FROM o) ELSE p.key + 1 END),
r AS (SELECT *, [x for x in {_TRADES} if x <> trade] AS rest FROM d)
SELECT key, exposure, gold, CASE WHEN NOT gold AND {_DU('anon')} < 0.5 THEN 'Person ' || upper(substr(sha1(key || ':' || exposure), 1, 2)) END AS placeholder, gold AND {_DU('swap:trade')} < 0.2 AS swapped, array_to_string([x for x in [CASE WHEN gold OR contains(beside, city) THEN 'city' END, CASE WHEN gold OR contains(beside, region) THEN 'region' END, CASE WHEN gold OR contains(beside, trade) THEN 'trade' END] if x IS NOT NULL], ',') AS supported,
CASE WHEN gold AND {_DU('swap:trade')} < 0.2 THEN rest[floor({_DU('value:trade')} * len(rest))::INT + 1] ELSE trade END AS said, true AS shown FROM r""")  # fmt: skip
def retrieval_documents(spark: SparkSession, sf: str) -> DataFrame:
    own = Q.people(spark, sf)
    ends = own.agg(F.min("key").alias("a"), F.max("key").alias("z"))
    cards = own.crossJoin(F.broadcast(ends)).select(F.when(F.col("key") == F.col("a"), F.col("z")).otherwise(F.col("key") - 1).alias("key"), F.array(Q.card()).alias("cards"))  # one row
    shown = own.withColumn("exposure", F.explode(F.sequence(F.lit(0), (F.col("key") % 2).cast("int"))))
    made = B.retrieval_documents(shown, cards, {"city": [], "region": [], "trade": _TRADES}, Q.TEMPLATES)
    said = F.coalesce(*(F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in _TRADES))
    masked = F.aggregate("mask", F.lit(0), lambda a, m: a + m) == F.size("tokens")
    whole = F.size("supported") == 3
    return made.select("key", "exposure", "gold", "placeholder", (F.size("swapped") > 0).alias("swapped"), F.array_join("supported", ",").alias("supported"), said.alias("said"), (masked == whole).alias("shown"))

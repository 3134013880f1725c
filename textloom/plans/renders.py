"""Queries that render question sets, biographies and chains, over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textloom.functions import renders as R, text as T
from textloom.operators import metrics as M
from textloom.plans.corpus import DRAW
from textloom.plans.registry import register
from textloom.storage import table

PHRASES = ["The passage does not say.", "No answer is given.", "It cannot be answered from this."]
_S = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return _S.format(x)


def _full_sql(xs: str) -> str:
    return f"list_filter(list_transform({xs}, lambda x: {strip_sql('x')}), lambda x: x <> '')"


_PASSAGE = "SELECT doc_id, text AS context, substr(text, 1, 60) AS question, CASE WHEN doc_id % 3 = 0 THEN [' ', ''] ELSE [' ', substr(text, 61, 30)] END AS answers FROM documents"
_PICK = f"['{PHRASES[0]}', '{PHRASES[1]}', '{PHRASES[2]}'][floor({DRAW.format("'1:' || doc_id")} * 3)::INT + 1]"


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    answers = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit(" "), F.substring("text", 61, 30)))
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("context"), F.substring("text", 1, 60).alias("question"), answers.alias("answers"))


@register("passage_turns", f"""
SELECT doc_id, sha1('{R.INSTRUCTION}' || chr(10) || chr(10) || 'Passage:' || chr(10) || {strip_sql('context')} || chr(10) || chr(10) || 'Question: ' || {strip_sql('question')}) AS prompt, coalesce({_full_sql('answers')}[1], {_PICK}) AS response
FROM ({_PASSAGE}) WHERE {strip_sql('context')} <> '' AND {strip_sql('question')} <> ''""")  # fmt: skip
def passage_turns(spark: SparkSession, sf: str) -> DataFrame:
    x = R.passage_turns(F.col("context"), F.col("question"), F.col("answers"), PHRASES, F.col("doc_id"))
    return _passages(spark, sf).select("doc_id", x.alias("x")).where("x IS NOT NULL").select("doc_id", F.sha1(F.col("x.prompt").cast("binary")).alias("prompt"), "x.response")


@register("passage_evidence", f"""
SELECT doc_id, sha1('{R.INSTRUCTION}' || chr(10) || chr(10) || 'Question: ' || {strip_sql('question')}) AS prompt, coalesce({_full_sql('answers')}[1], '') AS answer, sha1({strip_sql('context')}) AS gold, 0 AS near
FROM ({_PASSAGE}) WHERE {strip_sql('context')} <> '' AND {strip_sql('question')} <> ''""")  # fmt: skip
def passage_evidence(spark: SparkSession, sf: str) -> DataFrame:
    x = _passages(spark, sf).select("doc_id", R.passage_evidence(F.col("context"), F.col("question"), F.col("answers")).alias("x")).where("x IS NOT NULL")
    return x.select("doc_id", F.sha1(R.evidence_prompt(F.col("x.question")).cast("binary")).alias("prompt"), "x.answer", F.sha1(F.get("x.gold", F.lit(0)).cast("binary")).alias("gold"), F.size("x.near").alias("near"))


_HOPS = """SELECT doc_id, substr(text, 1, 30) AS question, substr(text, 31, 12) AS answer, [' ' || lang, source, 't' || doc_id] AS titles,
 [[substr(text, 1, 40), ' ', substr(text, 41, 40)], [' '], [substr(text, 81, 50), '.']] AS sentences, CASE WHEN doc_id % 5 = 0 THEN ['none'] ELSE [lang, 't7'] END AS support FROM documents"""
_PARAGRAPHS = f"list_filter([{{'t': {strip_sql('titles[i]')}, 'b': {strip_sql("array_to_string(sentences[i], '')")}}} for i in [1, 2, 3]], lambda p: p.b <> '')"


def _hops(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    cut = lambda a, n: F.substring(text, a, n)
    sentences = F.array(F.array(cut(1, 40), F.lit(" "), cut(41, 40)), F.array(F.lit(" ")), F.array(cut(81, 50), F.lit(".")))
    titles = F.array(F.concat(F.lit(" "), F.col("lang")), F.col("source"), F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    support = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("none"))).otherwise(F.array(F.col("lang"), F.lit("t7")))
    return table(spark, sf, "documents").select("doc_id", cut(1, 30).alias("question"), cut(31, 12).alias("answer"), titles.alias("titles"), sentences.alias("sentences"), support.alias("support"))


@register("multi_hop_turns", f"""
SELECT doc_id, sha1('{R.INSTRUCTION}' || chr(10) || chr(10) || 'Passage:' || chr(10) || shown || chr(10) || chr(10) || 'Question: ' || {strip_sql('question')}) AS prompt, {strip_sql('answer')} AS response
FROM (SELECT *, array_to_string(list_transform({_PARAGRAPHS}, lambda p: p.t || ': ' || p.b), chr(10) || chr(10)) AS shown FROM ({_HOPS})) WHERE {strip_sql('question')} <> '' AND {strip_sql('answer')} <> '' AND shown <> ''""")  # fmt: skip
def multi_hop_turns(spark: SparkSession, sf: str) -> DataFrame:
    x = R.multi_hop_turns(*(F.col(c) for c in ("question", "answer", "titles", "sentences")))
    return _hops(spark, sf).select("doc_id", x.alias("x")).where("x IS NOT NULL").select("doc_id", F.sha1(F.col("x.prompt").cast("binary")).alias("prompt"), "x.response")


@register("multi_hop_evidence", f"""
SELECT doc_id, {strip_sql('answer')} AS answer, array_to_string([p.t for p in ps if list_contains(support, p.t)], '|') AS gold, array_to_string([p.t for p in ps if NOT list_contains(support, p.t)], '|') AS near
FROM (SELECT *, {_PARAGRAPHS} AS ps FROM ({_HOPS})) WHERE {strip_sql('question')} <> '' AND {strip_sql('answer')} <> '' AND len([p.t for p in ps if list_contains(support, p.t)]) > 0""")  # fmt: skip
def multi_hop_evidence(spark: SparkSession, sf: str) -> DataFrame:
    x = R.multi_hop_evidence(*(F.col(c) for c in ("question", "answer", "titles", "sentences", "support")))
    titles = lambda c: F.array_join(F.transform(c, lambda t: F.substring_index(t, ": ", 1)), "|")
    return _hops(spark, sf).select("doc_id", x.alias("x")).where("x IS NOT NULL").select("doc_id", "x.answer", titles("x.gold").alias("gold"), titles("x.near").alias("near"))


_WORKED = """SELECT p_partkey, ' ' || p_name AS question, CASE p_partkey % 4 WHEN 0 THEN '2+2=<<2+2=4>>4' || chr(10) || '#### ' || p_size WHEN 1 THEN '#### ' || p_size WHEN 2 THEN p_type || ' <<1=1>>' || chr(10) ELSE ' ' END AS answer FROM part"""


def _worked(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    answer = F.when(k == 0, F.concat(F.lit("2+2=<<2+2=4>>4\n#### "), size)).when(k == 1, F.concat(F.lit("#### "), size)).when(k == 2, F.concat("p_type", F.lit(" <<1=1>>\n"))).otherwise(" ")
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("question"), answer.alias("answer"))


@register("worked_turns", f"""
WITH w AS (SELECT p_partkey, {strip_sql('question')} AS prompt, regexp_replace({strip_sql('answer')}, '<<[^>]*>>', '', 'g') AS a FROM ({_WORKED})),
x AS (SELECT p_partkey, prompt, {strip_sql("string_split(a, '####')[1]")} AS body, CASE WHEN contains(a, '####') THEN {strip_sql("substr(a, strpos(a, '####') + 4)")} ELSE '' END AS final FROM w)
SELECT p_partkey, prompt, CASE WHEN final = '' THEN body WHEN body = '' THEN 'The answer is ' || final || '.' ELSE body || chr(10) || 'The answer is ' || final || '.' END AS response FROM x WHERE prompt <> '' AND (body <> '' OR final <> '')""")  # fmt: skip
def worked_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _worked(spark, sf).select("p_partkey", R.worked_turns(F.col("question"), F.col("answer")).alias("x")).where("x IS NOT NULL").select("p_partkey", "x.prompt", "x.response")


_CONT = "list_transform({0}, lambda t: ' ' || t)"
_CLEAN = f"replace(regexp_replace(replace({strip_sql('{0}')}, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')"


def _choices_sql() -> str:
    """One row for each task and part: contexts, continuations and the gold option."""
    same = lambda context, texts: f"[{context} for t in {texts}] AS contexts, {_CONT.format(texts)} AS conts"
    three = "[p_brand, p_type, p_name]"
    clean = lambda x: _CLEAN.replace("{0}", x)
    head = clean("p_brand || ': ' || p_type || ' ' || upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2))")
    ask = "'Question: ' || p_name || chr(10) || 'Answer:'"
    key = "(p_size % 4 + 1)::VARCHAR"
    tasks = {
        "completion": (same(head, f"[{clean("p_type || ' [title] x'")}, {clean("'[h] ' || p_brand || '  y'")}]"), "p_size % 2", "true"),
        "labelled": (same(ask, three), f"list_position(['1', '2', '3'], {key}) - 1", f"list_contains(['1', '2', '3'], {key})"),
        "stem": (same("p_name", three), f"list_position(['1', '2', '3'], {key}) - 1", f"list_contains(['1', '2', '3'], {key})"),
        "solutions": (same(ask, "[p_brand, p_type]"), "p_size % 2", "true"),
        "blank": ("[p_type || ' ' || o for o in [p_brand, 'it']] AS contexts, [' ' || p_name || ' end.' for o in [1, 2]] AS conts", "p_size % 2", "true"),
        "supported": (same(strip_sql("CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END || chr(10) || " + ask), "[p_brand, 'a', 'b', p_type]"), "3", "true"),
        "yes_no": (same("p_type || chr(10) || 'Question: ' || p_name || '?' || chr(10) || 'Answer:'", "['no', 'yes']"), "(p_size > 25)::INT", "true"),
        "last_word": ("[array_to_string(string_split(p_name, ' ')[:-2], ' ')] AS contexts, [' ' || string_split(p_name, ' ')[-1]] AS conts", "0", "contains(p_name, ' ')"),
        "lettered": (same(f"'The following are multiple choice questions (with answers) about ' || replace(p_type, '_', ' ') || '.' || chr(10) || chr(10) || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. c' || chr(10) || 'D. d' || chr(10) || 'Answer:'", "['A', 'B', 'C', 'D']"), "p_size % 4", "p_size % 3 > 0"),
    }
    rows = " UNION ALL ".join(f"SELECT p_partkey, '{name}' AS task, ({gold})::INT AS gold, {said} FROM part WHERE {where}" for name, (said, gold, where) in tasks.items())
    return f"SELECT p_partkey, task, gold, len(conts)::INT AS n, sha1(array_to_string([contexts[i] || '|' || conts[i] for i in range(1, len(conts) + 1)], chr(10))) AS digest FROM ({rows})"


@register("choice_items", _choices_sql())
def choice_items(spark: SparkSession, sf: str) -> DataFrame:
    name, brand, kind, size = (F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))
    three, labels, key = F.array(brand, kind, name), F.array(*map(F.lit, "123")), (size % 4 + 1).cast("string")
    tasks = {
        "completion": R.sentence_completion(brand, kind, name, F.array(F.concat(kind, F.lit(" [title] x")), F.concat(F.lit("[h] "), brand, F.lit("  y"))), size % 2),
        "labelled": R.labelled_choice(name, labels, three, key),
        "stem": R.stem_choice(name, labels, three, key),
        "solutions": R.two_solutions(name, brand, kind, size % 2),
        "blank": R.filled_blank(F.concat(kind, F.lit(" _ "), name, F.lit(" end.  ")), brand, F.lit("it"), size % 2 + 1),
        "supported": R.supported_choice(F.when(size % 2 != 0, kind), name, [brand, F.lit("a"), F.lit("b")], kind),
        "yes_no": R.yes_or_no(kind, name, size > 25),
        "last_word": R.last_word(name),
        "lettered": R.lettered_choice(kind, name, F.when(size % 3 > 0, F.array(brand, kind, F.lit("c"), F.lit("d"))).otherwise(F.array(brand)), size % 4),
    }
    items = F.explode(F.array(*(F.struct(F.lit(n).alias("task"), x.alias("item")) for n, x in tasks.items())))
    said = F.array_join(F.transform("item.options", lambda o: F.concat(o["context"], F.lit("|"), o["continuation"])), "\n")
    rows = table(spark, sf, "part").select("p_partkey", items.alias("x")).select("p_partkey", "x.task", "x.item").where("item IS NOT NULL")
    return rows.select("p_partkey", "task", "item.gold", F.size("item.options").alias("n"), F.sha1(said.cast("binary")).alias("digest"))


@register("open_questions", f"""
WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN [] ELSE [lower(p_brand), ' '] END AS norm, [p_brand, ''] AS alias, CASE WHEN p_size % 2 = 0 THEN ' ' || p_type ELSE '' END AS value, CASE WHEN p_size % 5 = 0 THEN [' '] ELSE [p_type] END AS short, p_type || ' #### 1,' || (100 + p_size) AS worked FROM part),
a AS (SELECT *, list_concat(CASE WHEN len(list_filter(norm, lambda x: {strip_sql('x')} <> '')) > 0 THEN list_filter(norm, lambda x: {strip_sql('x')} <> '') ELSE list_filter(alias, lambda x: {strip_sql('x')} <> '') END, CASE WHEN {strip_sql('value')} <> '' THEN [{strip_sql('value')}] ELSE [] END) AS said FROM p)
SELECT p_partkey, 'open' AS task, 'Question: ' || p_name || chr(10) || 'Answer:' AS prompt, array_to_string(said, '|') AS answers FROM a WHERE len(said) > 0
UNION ALL SELECT p_partkey, 'short', 'Q: ' || p_name || chr(10) || chr(10) || 'A:', array_to_string(short, '|') FROM p WHERE short <> [' ']
UNION ALL SELECT p_partkey, 'number', 'Question: ' || p_name || chr(10) || 'Answer:', replace({strip_sql("string_split(worked, '####')[-1]")}, ',', '') FROM p""")  # fmt: skip
def open_questions(spark: SparkSession, sf: str) -> DataFrame:
    name, brand, kind, size = (F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))
    none = F.array().cast("array<string>")
    tasks = {
        "open": R.open_question(name, F.when(size % 3 == 0, none).otherwise(F.array(F.lower(brand), F.lit(" "))), F.array(brand, F.lit("")), F.when(size % 2 == 0, F.concat(F.lit(" "), kind))),
        "short": R.short_question(name, F.when(size % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(kind))),
        "number": R.number_question(name, F.concat(kind, F.lit(" #### 1,"), (size + 100).cast("string"))),
    }
    items = F.explode(F.array(*(F.struct(F.lit(n).alias("task"), x.alias("item")) for n, x in tasks.items())))
    rows = table(spark, sf, "part").select("p_partkey", items.alias("x")).where("x.item IS NOT NULL")
    return rows.select("p_partkey", "x.task", "x.item.prompt", F.array_join("x.item.answers", "|").alias("answers"))


ENTITY, ATTRIBUTE = ["BUILDING", "MACHINERY"], ["FURNITURE"]
_FACTS = f"""SELECT c_custkey AS id, c_name AS subject, c_mktsegment AS relation, n_name AS object, CASE WHEN c_custkey % 6 = 0 THEN 'Where is it?' ELSE 'Where does ' || lower(c_name) || ' live?' END AS question, c_acctbal AS pop,
CASE c_custkey % 3 WHEN 0 THEN [n_name, 'Place ' || c_custkey] WHEN 1 THEN ['it''s ' || n_name, n_name] ELSE ['somewhere', n_name] END AS answers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 17 <> 0"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with answers listed as JSON, with single quotes, or plain; every 17th has no popularity."""
    people = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k, place = F.col("c_custkey"), F.col("n_name")
    listed = F.when(k % 3 == 0, F.concat(F.lit('["'), place, F.lit('", " '), F.lit("Place "), k.cast("string"), F.lit('"]'))).when(k % 3 == 1, F.concat(F.lit("['it\\'s "), place, F.lit("', '"), place, F.lit("']"))).otherwise("somewhere")
    question = F.when(k % 6 == 0, "Where is it?").otherwise(F.concat(F.lit("Where does "), F.lower("c_name"), F.lit(" live?")))
    popularity = F.when(k % 17 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    fact = R.popular_fact(F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit(" "), place), question, popularity, listed)
    return people.select(k.alias("id"), fact.alias("x")).where("x IS NOT NULL").select("id", "x.*")


@register("popular_facts", f"""
WITH f AS ({_FACTS}), q AS (SELECT quantile_cont(pop, 1.0 / 3) AS low, quantile_cont(pop, 2.0 / 3) AS high FROM f)
SELECT id, array_to_string(answers, '|') AS answers, CASE WHEN relation IN ('BUILDING', 'MACHINERY') THEN 'entity' WHEN relation = 'FURNITURE' THEN 'attribute' ELSE 'other' END AS class,
CASE WHEN pop <= low THEN 'tail' WHEN pop <= high THEN 'mid' ELSE 'head' END AS tier, CASE WHEN id % 6 <> 0 THEN 'Where does X live?' END AS prior FROM f, q""")  # fmt: skip
def popular_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = _facts(spark, sf)
    low, high = M.quantiles(facts, "popularity", [1 / 3, 2 / 3])
    tier = F.when(F.col("popularity") <= low, "tail").when(F.col("popularity") <= high, "mid").otherwise("head")
    return facts.select("id", F.array_join("answers", "|").alias("answers"), R.relation_class(F.col("relation"), ENTITY, ATTRIBUTE).alias("class"), tier.alias("tier"), R.prior_question(F.col("question"), F.col("subject")).alias("prior"))


TEMPLATES = {
    "city": ["{s} lives in {v}.", "The home of {s} is {v}."],
    "region": ["{s} comes from {v}.", "{v} is where {s} was raised."],
    "trade": ["{s} works in {v}.", "By trade {s} is in {v}."],
}


def people(spark: SparkSession, sf: str) -> DataFrame:
    """key, name, pronoun, city, region and trade of every customer."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    pronoun = F.when(F.col("c_custkey") % 2 == 0, "she").otherwise("he")
    return c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), pronoun.alias("pronoun"), F.col("n_name").alias("city"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("trade"))


PEOPLE = "SELECT c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'she' ELSE 'he' END AS pronoun, n_name AS city, r_name AS region, c_mktsegment AS trade FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _sentences_sql() -> str:
    """A list of (text, label) for the chosen template, as a CASE over attributes and templates."""
    cases = []
    for attribute, ways in TEMPLATES.items():
        for k, way in enumerate(ways):
            parts, rest, first = [], way, True
            while rest:
                cut = min(at for at in (rest.find("{s}"), rest.find("{v}"), len(rest)) if at >= 0)
                if cut:
                    parts.append(f"{{'text': '{rest[:cut]}', 'label': NULL::VARCHAR}}")
                    first = False
                if cut < len(rest):
                    who = "upper(substr(pronoun, 1, 1)) || substr(pronoun, 2)" if first else "pronoun"
                    parts.append(f"{{'text': CASE WHEN named THEN name ELSE {who} END, 'label': CASE WHEN named THEN 'name' END}}" if rest[cut : cut + 3] == "{s}" else f"{{'text': {attribute}, 'label': '{attribute}'}}")
                    first = False
                rest = rest[cut + 3 :]
            cases.append(f"WHEN attribute = '{attribute}' AND chosen = {k} THEN [{', '.join(parts)}]")
    return "CASE " + " ".join(cases) + " END"


def _drawn_sql() -> str:
    u = lambda what, a: DRAW.format(f"'42:' || key || ':{what}:{a}'")
    return " UNION ALL ".join(f"SELECT *, '{a}' AS attribute, {u('order', a)} AS place, floor({u('template', a)} * {len(w)})::INT AS chosen, {u('name', a)} < 0.5 AS own FROM p" for a, w in TEMPLATES.items())


@register("biographies", f"""
WITH p AS ({PEOPLE}), d AS ({_drawn_sql()}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS i FROM d), n AS (SELECT *, i = 1 OR own AS named FROM o),
s AS (SELECT key, i, CASE WHEN i > 1 THEN list_concat([{{'text': ' ', 'label': NULL::VARCHAR}}], {_sentences_sql()}) ELSE {_sentences_sql()} END AS parts FROM n),
t AS (SELECT key, flatten(list(parts ORDER BY i)) AS parts FROM s GROUP BY key)
SELECT key, array_to_string([x.text for x in parts], '') AS text, array_to_string([(coalesce(list_sum([length(y.text) for y in parts[:i - 1]]), 0))::INT || '-' || (list_sum([length(y.text) for y in parts[:i]]))::INT || ':' || parts[i].label for i in range(1, len(parts) + 1) if parts[i].label IS NOT NULL], ' ') AS spans FROM t""")  # fmt: skip
def biographies(spark: SparkSession, sf: str) -> DataFrame:
    x = R.biography(F.col("key"), F.col("name"), F.col("pronoun"), {a: F.col(a) for a in TEMPLATES}, TEMPLATES)
    said = F.transform("x.spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["label"]))
    return people(spark, sf).select("key", x.alias("x")).select("key", "x.text", F.array_join(said, " ").alias("spans"))


def card(name: Column | str = "name", city: Column | str = "city") -> Column:
    """A person's store card, in a form that no biography template has."""
    return F.format_string("%s. Home: %s, %s. Trade: %s.", name, city, "region", "trade")


CARD = "name || '. Home: ' || city || ', ' || region || '. Trade: ' || trade || '.'"


@register("store_cards", f"SELECT key, {CARD} AS card FROM ({PEOPLE})")
def store_cards(spark: SparkSession, sf: str) -> DataFrame:
    return people(spark, sf).select("key", card().alias("card"))


PROBES = {("city", "corpus"): ("{name} lives in", "."), ("city", "question"): ("Q: Where does {name} live?", "\n"), ("trade", "corpus"): ("{name} works in", "."), ("trade", "question"): ("Q: What is the trade of {name}?", "\n")}


@register("probe_prompts", "SELECT key, attribute, form, replace(prompt, '{name}', name) AS prompt, terminator FROM (" + PEOPLE + ") p, (VALUES " + ", ".join(f"('{a}', '{f}', '{p}', " + ("chr(10)" if t == "\n" else f"'{t}'") + ")" for (a, f), (p, t) in PROBES.items()) + ") AS v(attribute, form, prompt, terminator)")
def probe_prompts(spark: SparkSession, sf: str) -> DataFrame:
    forms = spark.createDataFrame([(*k, *v) for k, v in PROBES.items()], "attribute string, form string, prompt string, terminator string")
    asked = people(spark, sf).crossJoin(F.broadcast(forms))  # a few templates
    return asked.select("key", "attribute", "form", F.replace("prompt", F.lit("{name}"), F.col("name")).alias("prompt"), "terminator")


@register("written_chains", f"""
WITH c AS (SELECT key, name, city, region, 'Step 1: ' || city || '. Answer: ' || region || '.' AS bridge, CASE key % 3 WHEN 0 THEN 'Step 1: ' || city || 'x. Answer:' || region WHEN 1 THEN 'It is ' || city ELSE 'Step 1: ' || city || '. Answer: ' || region || '.' END AS said FROM ({PEOPLE}))
SELECT key, 'Which region holds the nation of ' || name || '?' AS question, bridge, CASE WHEN contains(said, 'Answer:') THEN substr(said, 1, strpos(said, 'Answer:') + 6) || ' ' ELSE said END AS prefix,
CASE WHEN contains(said, 'Answer:') THEN regexp_replace(substr(said, strpos(said, 'Answer:') + 7), '^ ', '') END AS rest, (key % 3 <> 0)::INT AS hits FROM c""")  # fmt: skip
def written_chains(spark: SparkSession, sf: str) -> DataFrame:
    chain = F.array("name", "city", "region")
    k, bridge = F.col("key") % 3, R.written_bridge(chain)
    said = F.when(k == 0, F.concat(F.lit("Step 1: "), "city", F.lit("x. Answer:"), "region")).when(k == 1, F.concat(F.lit("It is "), "city")).otherwise(bridge)
    rows = people(spark, sf).select("key", R.chain_question(F.col("name"), ["the nation of {x}"], "Which region holds {x}?").alias("question"), bridge.alias("bridge"), said.alias("said"), chain.alias("chain"))
    hits = F.size(F.filter(R.bridge_hits(F.col("said"), F.col("chain")), lambda h: h))
    return rows.select("key", "question", "bridge", R.split_bridge(F.col("said")).alias("x"), hits.alias("hits")).select("key", "question", "bridge", "x.prefix", "x.rest", "hits")


@register("few_shot_prefix", f"""
WITH o AS (SELECT 'Question: ' || p_name || chr(10) || 'Answer: ' || p_brand AS shot, sha1('5:' || p_partkey) AS h FROM part WHERE p_size % 4 < 3 ORDER BY h LIMIT 4) SELECT string_agg(shot, chr(10) || chr(10) ORDER BY h) || chr(10) || chr(10) AS prefix FROM o""")  # fmt: skip
def few_shot_prefix(spark: SparkSession, sf: str) -> DataFrame:
    key = (F.col("p_size") % 4 + 1).cast("string")
    item = R.labelled_choice(F.col("p_name"), F.array(*map(F.lit, "123")), F.array("p_brand", "p_brand", "p_brand"), key)
    shots = table(spark, sf, "part").select(T.order_key(5, F.col("p_partkey")).alias("h"), item.alias("x")).where("x IS NOT NULL").orderBy("h").limit(4)
    gold = F.get("x.options", F.col("x.gold"))
    said = F.array_sort(F.collect_list(F.struct("h", F.concat(gold["context"], gold["continuation"]).alias("shot"))))
    return shots.agg(F.concat(F.array_join(F.transform(said, lambda s: s["shot"]), "\n\n"), F.lit("\n\n")).alias("prefix"))


#: A text with every character that isn't of a word doubled, so that each occurrence can take its own border on both sides.
_SEP = r"[^\pL\pN\pM_]"
DOUBLED = f"regexp_replace({{0}}, '({_SEP})', '\\1\\1', 'g')"
WHOLE = f"(?i)(^|{_SEP}){{0}}($|{_SEP})"


@register("term_occurrences", "SELECT doc_id, (" + " + ".join(f"len(regexp_extract_all({DOUBLED.format('text')}, '{WHOLE.format(t)}'))" for t in ("the", "les", "été", "der")) + ")::BIGINT AS n FROM documents")
def term_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    found = sum((T.occurrences(F.col("text"), F.lit(t)) for t in ("the", "les", "été", "der")), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", found.cast("long").alias("n"))

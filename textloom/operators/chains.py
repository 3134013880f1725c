"""Typed relation chains: which compose, which are held out, and questions whose buffers hold a chain among distractors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions.text import draw, order_key


@dataclass(frozen=True)
class Relation:
    """A relation from entities of one type to another; ``phrase`` and ``question`` take ``{x}``."""

    name: str
    domain: str
    range: str
    phrase: str
    question: str


def relation_table(spark: SparkSession, relations: tuple[Relation, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.domain, r.range) for r in relations], "name string, domain string, range string")


def compositions(relations: DataFrame, length: int) -> DataFrame:
    """(chain, range): every tuple of relations whose domains are the ranges before them."""
    found = relations.select(F.array("name").alias("chain"), "range")
    step = relations.select(F.col("name").alias("__next"), "domain", F.col("range").alias("__range"))
    for _ in range(length - 1):
        found = found.join(F.broadcast(step), F.col("range") == F.col("domain")).select(F.array_append("chain", F.col("__next")).alias("chain"), F.col("__range").alias("range"))  # a few relations
    return found


def pairs_of(chain: Column) -> Column:
    """The consecutive pairs of a chain, joined by a bar."""
    n = F.size(chain)
    return F.zip_with(F.slice(chain, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chain, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("|"), b))


def held_out_pairs(relations: DataFrame, share: float = 0.2, seed: int = 0, tries: int = 1000) -> DataFrame:
    """(pair): a seeded draw of the 2-chains, at least two, repeated until every relation that composes stays in one that isn't drawn."""
    two = compositions(relations, 2).select(F.array_join("chain", "|").alias("pair"), "chain")
    n = two.count()
    held = max(2, round(share * n))
    for attempt in range(tries):
        order = two.orderBy(order_key(seed, F.lit(attempt), F.col("pair")))
        drawn = order.limit(held)
        rest = two.join(drawn.select("pair"), "pair", "left_anti")
        names = lambda df: df.select(F.explode("chain").alias("r")).distinct()
        if not names(two).join(names(rest), "r", "left_anti").take(1):
            return drawn.select("pair")
    raise ValueError("no draw keeps every relation in a seen pair")


def seen_compositions(chains: DataFrame, held: DataFrame) -> DataFrame:
    """The chains that hold no held-out pair; single relations all stay."""
    lost = chains.select("chain", F.explode(pairs_of(F.col("chain"))).alias("pair")).join(F.broadcast(held), "pair").select("chain").distinct()  # a few pairs
    return chains.join(lost, "chain", "left_anti")


def questions(ids: DataFrame, chains: DataFrame, n_distractors: int, seed: int = 42) -> DataFrame:
    """(qid, chain, entities, facts): a drawn chain for each id, its true entities e0 to ek, and its buffer of facts (s, r, o, kind, hop).

    The buffer holds the chain (gold, with hops from 1), a decoy chain over the same relations (C), two further facts of the final relation
    whose subjects, on two hops or more, another fact names (A), and facts of the chain's relations over other entities (A) until
    ``n_distractors`` stand beside the chain. Entities are named by a hash of question and slot, so no two are alike; the facts
    stand in a drawn order. All of it follows from the id.
    """
    k = F.size("chain")
    listed = chains.agg(F.array_sort(F.collect_list("chain")).alias("all"))
    own = ids.crossJoin(F.broadcast(listed)).select("qid", F.get("all", F.floor(draw(seed, F.lit("chain"), F.col("qid")) * F.size("all")).cast("int")).alias("chain"))  # one row of a few chains
    entity = lambda slot: F.concat(F.lit("E"), F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string"), slot).cast("binary")), 1, 10))
    named = lambda what, i: entity(F.concat(F.lit(what), i.cast("string")))
    fact = lambda s, r, o, kind, hop: F.struct(s.alias("s"), r.alias("r"), o.alias("o"), F.lit(kind).alias("kind"), hop.cast("int").alias("hop"))
    chain = lambda what, kind, hop: F.transform("chain", lambda r, i: fact(named(what, i), r, named(what, i + 1), kind, hop(i)))
    last = F.element_at("chain", -1)
    ends = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: fact(named("s", i), last, named("o", i), "A", F.lit(0)))
    feeders = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: fact(named("f", i), F.concat(F.lit("feeds "), last), named("s", i), "A", F.lit(0)))
    fixed = F.concat(chain("e", "gold", lambda i: i + 1), chain("d", "C", lambda i: F.lit(0)), ends, F.when(k >= 2, feeders).otherwise(F.slice(feeders, 1, 0)))
    made = own.withColumn("fixed", fixed)
    room = F.greatest(F.lit(n_distractors) - (F.size("fixed") - k), F.lit(0))
    more = F.transform(F.slice(F.sequence(F.lit(0), F.lit(max(0, n_distractors))), F.lit(1), room), lambda i: fact(named("x", i), F.get("chain", F.pmod(i, F.greatest(k - 1, F.lit(1)))), named("y", i), "A", F.lit(0)))
    every = F.concat("fixed", more)
    mixed = F.transform(F.array_sort(F.transform(every, lambda f: F.struct(order_key(seed, F.col("qid"), f["s"], f["o"]).alias("h"), f.alias("f")))), lambda x: x["f"])
    entities = F.transform(F.sequence(F.lit(0), k), lambda i: named("e", i))
    return made.select("qid", "chain", entities.alias("entities"), mixed.alias("facts"))


def final_objects(chain: Column, facts: Column) -> Column:
    """The distinct objects of the final relation in the buffer's order: the answers that a reader can pick without composing."""
    return F.array_distinct(F.transform(F.filter(facts, lambda f: f["r"] == F.element_at(chain, -1)), lambda f: f["o"]))


def valid(question: Column, chain: Column, entities: Column, facts: Column, least: int = 4) -> Column:
    """Whether the question names its start and no later entity, the answer stands in one fact only, that of the last hop, and enough candidates are left."""
    low = F.lower(question)
    answer = F.element_at(entities, -1)
    holders = F.filter(facts, lambda f: (f["s"] == answer) | (f["o"] == answer))
    later = F.exists(F.slice(entities, F.lit(2), F.size(entities)), lambda e: F.contains(low, F.lower(e)))
    return F.contains(low, F.lower(F.get(entities, F.lit(0)))) & ~later & (F.size(holders) == 1) & (F.get(holders, F.lit(0))["hop"] == F.size(chain)) & (F.size(final_objects(chain, facts)) >= least)


def dealt_questions(spark: SparkSession, n: int, held: list[str], hops: dict[int, float], seed: int = 42) -> DataFrame:
    """(split, qid, hops, pair): train draws its hops by weight, one eval split a count of hops takes n of them each, held_out takes its pairs in turn."""
    total, bounds, at = sum(hops.values()), [], 0.0
    for h, w in list(hops.items())[:-1]:
        at += w / total
        bounds.append((at, h))
    drawn = F.lit(list(hops)[-1])
    for bound, h in reversed(bounds):
        drawn = F.when(draw(seed, F.lit("hops"), F.col("id")) < bound, h).otherwise(drawn)
    ids = spark.range(n)
    none = F.lit(None).cast("string")
    parts = [ids.select(F.lit("train").alias("split"), F.col("id").alias("qid"), drawn.cast("int").alias("hops"), none.alias("pair"))]
    parts += [ids.select(F.lit(f"eval_{h}").alias("split"), F.col("id").alias("qid"), F.lit(h).alias("hops"), none.alias("pair")) for h in hops]
    parts.append(ids.select(F.lit("held_out").alias("split"), F.col("id").alias("qid"), F.lit(2).alias("hops"), F.get(F.array(*map(F.lit, held)), F.pmod("id", F.lit(len(held))).cast("int")).alias("pair")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found

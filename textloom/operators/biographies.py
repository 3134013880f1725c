"""People, their biographies as documents with evidence, and the names and pools that they are made of."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import renders as D
from textloom.functions.text import draw, order_key
from textloom.operators import rows as P
from textloom.operators.mixing import hash_bucket, running_total


def fresh_names(ids: DataFrame, first: list[str], last: list[str], taken: DataFrame, seed: int = 42, tries: int = 50) -> DataFrame:
    """(id, name): a drawn name for each id that isn't taken; a name that is gets redrawn, up to ``tries`` times.

    Draws follow from the id alone, so two ids may share a name; ``taken`` has name. Ids whose draws are all taken have a null name.
    """
    pick = lambda words, what: F.get(F.array(*map(F.lit, words)), F.floor(draw(seed, F.lit(what), F.col("id"), F.col("try")) * len(words)).cast("int"))
    each = ids.select("id").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("name", F.concat(pick(first, "first"), F.lit(" "), pick(last, "last")))
    free = each.join(taken.select("name").distinct(), "name", "left_anti").groupBy("id").agg(F.min_by("name", "try").alias("name"))
    return ids.select("id").join(free, "id", "left")


def layout(people: DataFrame, fillers: DataFrame, seed: int = 42) -> DataFrame:
    """(kind, key, exposure, place): every person as often as their tier says, and the filler windows, in one seeded order from 1.

    ``people`` has key and tier, ``fillers`` key.
    """
    shown = people.select(F.lit("bio").alias("kind"), "key", F.explode(F.sequence(F.lit(0), F.col("tier") - 1)).alias("exposure"))
    both = shown.unionByName(fillers.select(F.lit("filler").alias("kind"), "key", F.lit(0).alias("exposure"))).withColumn("h", order_key(seed, F.col("kind"), F.col("key"), F.col("exposure")))
    return running_total(both, hash_bucket(F.col("h")), [F.col("h")], F.lit(1), "place").drop("h")


def _other(value: Column, v: Column) -> Column:
    return v != value


def _says(value: Column, card: Column) -> Column:
    return F.contains(card, value)


def retrieval_documents(people: DataFrame, others: DataFrame, attributes: dict[str, list[str]], templates: dict[str, list[str]], drop: float = 0.3, swap: float = 0.2, anonymous: float = 0.5, seed: int = 42) -> DataFrame:
    """(key, exposure, gold, placeholder, swapped, supported, text, tokens, mask) of the biographies that are shown with cards.

    ``people`` has key, exposure, name, pronoun and the attributes, ``others`` key and cards, the texts of the cards beside a person's own;
    ``attributes`` names each attribute's pool of values. The own card is left out at rate ``drop``. With it, each attribute takes another
    value of its pool, in biography and card, at rate ``swap``; without it the person is called by letters at rate ``anonymous``. A value is
    supported if the own card is there or another card says it, and the tokens of values that aren't, are not supervised.
    """
    u = lambda what: draw(seed, F.lit(what), F.col("key"), F.col("exposure"))
    own = people.join(others, "key").withColumn("gold", u("gold") >= drop)
    values, swapped, supported = {}, [], []
    for a, pool in attributes.items():
        own_value = F.col(a)
        rest = F.filter(F.array(*map(F.lit, pool)).cast("array<string>"), partial(_other, own_value))
        other = F.get(rest, F.floor(u(f"value:{a}") * F.size(rest)).cast("int"))
        moved = F.col("gold") & (u(f"swap:{a}") < swap) & (F.size(rest) > 0)
        values[a] = F.when(moved, other).otherwise(F.col(a))
        swapped.append(F.when(moved, F.lit(a)))
        beside = F.exists("cards", partial(_says, own_value))
        supported.append(F.when(F.col("gold") | beside, F.lit(a)))
    letters = F.concat(F.lit("Person "), F.upper(F.substring(F.sha1(F.concat_ws(":", F.col("key").cast("string"), F.col("exposure").cast("string")).cast("binary")), 1, 2)))
    placeholder = F.when(~F.col("gold") & (u("anon") < anonymous), letters)
    keep = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    told = own.withColumns({"placeholder": placeholder, "swapped": keep(swapped), "supported": keep(supported), **{f"__{a}": v for a, v in values.items()}})
    bio = D.biography(F.concat_ws("/", F.col("key").cast("string"), F.col("exposure").cast("string")), F.col("name"), F.col("pronoun"), {a: F.col(f"__{a}") for a in attributes}, templates, seed, shown=F.coalesce("placeholder", "name"))
    marked = told.withColumn("x", bio).withColumns({"text": F.col("x.text"), "spans": F.col("x.spans")}).withColumn("tokens", P.token_offsets(F.col("text")))
    lost = F.filter("spans", lambda s: (s["label"] != "name") & ~F.array_contains("supported", s["label"]))
    mask = F.transform(P.span_codes(F.col("tokens"), lost, {}, 1), lambda c: 1 - c)
    return marked.select("key", "exposure", "gold", "placeholder", "swapped", "supported", "text", "tokens", mask.alias("mask"))

"""Chat rendering and encoding with a per-token loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import tokens

ROLES = ("system", "user", "assistant")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): turns ordered, those that are blank or have no role dropped."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy("conv_id").agg(F.filter(ordered, lambda t: t["role"].isNotNull() & t["text"].rlike(r"\S")).alias("turns"))


def valid(turns: Column) -> Column:
    """Only known roles, and at least one assistant turn that says something."""
    return F.forall(turns, lambda t: F.coalesce(t["role"].isin(*ROLES), F.lit(False))) & F.exists(turns, lambda t: t["role"] == "assistant")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


def encoded(turns: Column) -> Column:
    """(ids, mask): a start mark, then per turn its marker (0), its tokens (1 if the assistant's), and an end mark (1) after the assistant."""
    plain = lambda s: F.struct(s.alias("id"), F.lit(0).alias("mask"))
    own = lambda t: F.transform(tokens(t["text"]), lambda w: F.struct(w.alias("id"), F.when(t["role"] == "assistant", 1).otherwise(0).alias("mask")))
    end = lambda t: F.when(t["role"] == "assistant", F.array(F.struct(F.lit("</s>").alias("id"), F.lit(1).alias("mask")))).otherwise(F.array().cast("array<struct<id:string,mask:int>>"))
    body = F.flatten(F.transform(turns, lambda t: F.concat(F.array(plain(F.concat(F.lit("<|"), t["role"], F.lit("|>")))), own(t), end(t))))
    return F.concat(F.array(plain(F.lit("<s>"))), body)


def prompt(turns: Column) -> Column:
    """Ids up to the last turn that isn't the assistant's, and the assistant's marker."""
    last = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] != "assistant", i + 1).otherwise(0)))
    return F.concat(F.transform(encoded(F.slice(turns, 1, F.coalesce(last, F.lit(0)))), lambda x: x["id"]), F.array(F.lit("<|assistant|>")))

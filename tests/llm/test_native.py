"""The operators with SQL: 8 and 9."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_format as C, decontam, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(agrees, name):
    agrees(queries.QUERIES[name], queries.ORACLES[name])


def brute_contamination(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for _, text in docs:
        w, hit, names = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        names = sorted(str(x) for x in names if x is not None)
        yield len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def test_contamination_matches_brute_force(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["ab", "cd", "é1", "x", "the", "same"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([3, 7, 9, 10, 11, 14, 30, 30])] + [(90, None), (91, "?!"), (92, "Z"), (6, "other words here"), (None, say(12))]
    docs = [(i, say(rng.randrange(0, 60)) + rng.choice(["", " " + (rng.choice(items)[1] or "")]) + say(5)) for i in range(60)] + [(100, None), (101, ""), (102, "?"), (103, "z"), (103, "z"), (None, items[6][1].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"t1": F.lit(1), "item": F.lit(2), "w": F.lit(3)})
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted((str(i), *b, b[1] > 0) for (i, _), b in zip(docs, brute_contamination(docs, items), strict=True))


def test_contamination_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.contamination(docs, items).collect()] == [False]
    assert decontam.contamination(docs.where("false"), items).count() == 0


def test_layouts(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        3: {"instruction": "q", "input": "", "output": "a"},
        4: {"instruction": "q", "input": "more", "output": "a"},
        5: {"prompt": "q", "response": "a", "id": 3},
        6: {"question": "q", "answer": None},
        7: {"unknown": 1},
    }
    rows = [(i, json.dumps(r)) for i, r in records.items()] + [(8, None), (9, "{broken"), (10, json.dumps({"messages": []}))]
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in C.canonical_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    pair = [("user", "q"), ("assistant", "a")]
    assert got[1] == ("messages", pair) and got[2] == ("conversations", pair) and got[3] == ("instruction_input", pair) and got[5] == ("prompt_response", pair)
    assert got[4][1][0] == ("user", "q\n\nmore") and got[6] == ("question_answer", [("user", "q"), ("assistant", "")])
    assert all(got[i] == (None, []) for i in (7, 8, 9, 10))


def test_paths_of_all_elements_count_and_strings_left_out_are_named(spark):
    records = [
        {"messages": [{"role": "user"}, {"role": "assistant", "content": "a", "note": "n"}], "system": "be kind", "meta": {"id": "x", "n": 2}},
        {"unknown": "text", "odd name": [["deep", "er"]]},
        {"prompt": "p", "response": "r"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = {r.conv_id: r for r in C.canonical_records(df).collect()}
    assert got[0].layout == "messages" and [(t.role, t.text) for t in got[0].turns] == [("user", ""), ("assistant", "a")]
    assert got[0].unmapped == ["messages[].note", "meta.id", "system"] and got[2].unmapped == []
    assert got[1].layout is None and got[1].turns == [] and got[1].unmapped == ["odd name", "unknown"]
    paths = df.select("conv_id", C._paths(F.col("record")).alias("p")).collect()
    assert sorted(p.path for p in paths[0].p) == ["messages", "messages[].content", "messages[].note", "messages[].role", "meta", "meta.id", "meta.n", "system"]


def test_schema_of_a_table_selects_its_row_layout(spark):
    turns = [(1, 0, "human", "q"), (1, 1, "gpt", "a"), (None, 0, None, None)]
    speakers = spark.createDataFrame(turns, "conversation_id long, position long, `from` string, value string").withColumn("extra", F.lit("e"))
    got = {r.conv_id: r for r in C.canonical_rows(speakers).collect()}
    assert got[1].layout == "speaker_rows" and [(t.role, t.text) for t in got[1].turns] == [("user", "q"), ("assistant", "a")] and got[1].unmapped == ["extra"]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert C.canonical_rows(speakers.drop("value")).count() == 0 and C.canonical_rows(speakers.where("false")).count() == 0
    nested = spark.createDataFrame([], "a struct<b:array<struct<c:string,d:int>>>, e array<string>")
    assert C.schema_paths(nested.schema) == [("a", False), ("a.b[]", False), ("a.b[].c", True), ("a.b[].d", False), ("e[]", True)]


def test_escapes_are_reversible(spark):
    rng = random.Random(9)
    parts = ["<|turn|>", "<|text|>", "<|end|>", "<", "\\", "|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[", "é", "\n", "a", "<\\|end|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    turns = [(i, k, rng.choice(["user", "assistant", "<|end|>", None]), rng.choice(texts + [None])) for i in range(80) for k in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "loss": F.lit(2)})
    got = {r.conv_id: r for r in C.read_back(C.formatted(C.canonical_rows(df))).collect()}
    want = {}
    for i, _, role, text in sorted(turns, key=lambda t: t[:2]):
        want.setdefault(i, []).append((role or "", text or ""))
    for i, said in want.items():
        assert [(t.role, t.text) for t in got[i].turns] == said
        assert got[i].loss_text == "".join(t for r, t in said if r == "assistant")
    whole = C.formatted(C.canonical_rows(df)).collect()
    assert all(r.formatted.count("<|turn|>") == len(want[r.conv_id]) and not re.search(r"(?<!\\)</?s>|\[/?INST\]", r.formatted) for r in whole)
    assert C.canonical_rows(df.where("false")).count() == 0

"""Rows of question sets as prompts, answers and scored options. A row that can't be used renders to null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.text import draw, strip

#: Default instruction over a passage; callers may give their own.
INSTRUCTION = "Answer the question from the passage. Say so if the passage does not hold the answer."
#: Fixed value: the sentence that a worked answer's marked result becomes.
FINAL = "The answer is "
#: Option letters of a four-way question.
LETTERS = ("A", "B", "C", "D")


def _said(text: Column) -> Column:
    return strip(F.coalesce(text.cast("string"), F.lit("")))


def _full(texts: Column) -> Column:
    """The stripped texts of an array that aren't blank."""
    return F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), _said), lambda x: x != "")


def pick(phrases: list[str], seed: int, key: Column) -> Column:
    """One of a few phrases by a seeded hash of the key."""
    return F.get(F.array(*map(F.lit, phrases)), F.floor(draw(seed, key) * len(phrases)).cast("int"))


def passage_turns(context: Column, question: Column, answers: Column, phrases: list[str], key: Column, seed: int = 1, instruction: str = INSTRUCTION) -> Column:
    """(prompt, response) of a question over a passage; without an answer that isn't blank one of the phrases declines."""
    prompt = F.concat(F.lit(f"{instruction}\n\nPassage:\n"), _said(context), F.lit("\n\nQuestion: "), _said(question))
    response = F.coalesce(F.get(_full(answers), F.lit(0)), pick(phrases, seed, key))
    return F.when((_said(context) != "") & (_said(question) != ""), F.struct(prompt.alias("prompt"), response.alias("response")))


def paragraphs(titles: Column, sentences: Column) -> Column:
    """(title, text) of paragraphs with a body: ``title: body``, a body being its sentences joined."""
    body = lambda s: strip(F.array_join(F.coalesce(s, F.array().cast("array<string>")), ""))
    n = F.least(F.size(titles), F.size(sentences))
    zipped = F.zip_with(F.slice(titles, F.lit(1), n), F.slice(sentences, F.lit(1), n), lambda t, s: F.struct(_said(t).alias("title"), body(s).alias("body")))
    kept = F.filter(zipped, lambda p: p["body"] != "")
    return F.transform(kept, lambda p: F.struct(p["title"].alias("title"), F.concat(p["title"], F.lit(": "), p["body"]).alias("text")))


def multi_hop_turns(question: Column, answer: Column, titles: Column, sentences: Column, instruction: str = INSTRUCTION) -> Column:
    """(prompt, response) over all paragraphs in their order, joined by blank lines."""
    shown = F.array_join(F.transform(paragraphs(titles, sentences), lambda p: p["text"]), "\n\n")
    prompt = F.concat(F.lit(f"{instruction}\n\nPassage:\n"), shown, F.lit("\n\nQuestion: "), _said(question))
    return F.when((_said(question) != "") & (_said(answer) != "") & (shown != ""), F.struct(prompt.alias("prompt"), _said(answer).alias("response")))


def evidence_prompt(question: Column, instruction: str = INSTRUCTION) -> Column:
    """The prompt without a passage, which comes through the evidence."""
    return F.concat(F.lit(f"{instruction}\n\nQuestion: "), question)


def passage_evidence(context: Column, question: Column, answers: Column) -> Column:
    """(question, answer, gold, near): the passage is gold even where the question has no answer."""
    answer = F.coalesce(F.get(_full(answers), F.lit(0)), F.lit(""))
    row = F.struct(_said(question).alias("question"), answer.alias("answer"), F.array(_said(context)).alias("gold"), F.array().cast("array<string>").alias("near"))
    return F.when((_said(context) != "") & (_said(question) != ""), row)


def multi_hop_evidence(question: Column, answer: Column, titles: Column, sentences: Column, support: Column) -> Column:
    """(question, answer, gold, near): paragraphs of supporting titles are gold, the others near; null without gold."""
    named = F.transform(F.coalesce(support, F.array().cast("array<string>")), _said)
    parts = paragraphs(titles, sentences)
    texts = lambda keep: F.transform(F.filter(parts, lambda p: F.array_contains(named, p["title"]) == keep), lambda p: p["text"])
    row = F.struct(_said(question).alias("question"), _said(answer).alias("answer"), texts(True).alias("gold"), texts(False).alias("near"))
    return F.when((_said(question) != "") & (_said(answer) != "") & (F.size(texts(True)) > 0), row)


def worked_turns(question: Column, answer: Column) -> Column:
    """(prompt, response) of a worked answer without its calculator marks; what follows the first #### becomes a sentence of its own line."""
    clean = F.regexp_replace(_said(answer), r"<<[^>]*>>", "")
    body = strip(F.substring_index(clean, "####", 1))
    final = F.when(F.instr(clean, "####") > 0, strip(F.substring(clean, F.instr(clean, "####") + 4, F.length(clean)))).otherwise("")
    closing = F.when(final != "", F.concat(F.lit(FINAL), final, F.lit(".")))
    response = F.concat_ws("\n", F.nullif(body, F.lit("")), closing)
    return F.when((_said(question) != "") & (_said(answer) != "") & (response != ""), F.struct(_said(question).alias("prompt"), response.alias("response")))


def _options(context: Column, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(context.alias("context"), F.concat(F.lit(" "), t).alias("continuation")))


def _item(options: Column, gold: Column) -> Column:
    return F.struct(options.alias("options"), gold.cast("int").alias("gold"))


def cleaned_ending(text: Column) -> Column:
    """A text without bracketed headers: `` [title]`` ends a sentence, other brackets go, then double spaces become single once."""
    return F.replace(F.regexp_replace(F.replace(strip(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def sentence_completion(label: Column, first: Column, second: Column, endings: Column, gold: Column) -> Column:
    """Endings after ``label: first Second``, header marks cleaned on both sides."""
    capital = F.concat(F.upper(F.substring(second, 1, 1)), F.lower(F.substring(second, F.lit(2), F.greatest(F.length(second), F.lit(1)))))
    context = cleaned_ending(F.concat(label, F.lit(": "), first, F.lit(" "), capital))
    return _item(_options(context, F.transform(endings, cleaned_ending)), gold)


def _question(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def labelled_choice(question: Column, labels: Column, texts: Column, key: Column) -> Column:
    """Options under ``Question: ... Answer:``; null if the key is none of the labels."""
    at = F.array_position(labels, key.cast("string"))
    return F.when(at > 0, _item(_options(_question(question), texts), at - 1))


def stem_choice(stem: Column, labels: Column, texts: Column, key: Column) -> Column:
    """Options right after the stem; null if the key is none of the labels."""
    at = F.array_position(labels, key.cast("string"))
    return F.when(at > 0, _item(_options(stem, texts), at - 1))


def two_solutions(goal: Column, first: Column, second: Column, gold: Column) -> Column:
    return _item(_options(_question(goal), F.array(first, second)), gold)


def filled_blank(sentence: Column, first: Column, second: Column, answer: Column) -> Column:
    """The option goes into the context at the first ``_``; what is scored is the shared rest. ``answer`` is 1 or 2; null without a blank."""
    blank = F.instr(sentence, "_")
    before, tail = F.substring(sentence, F.lit(1), blank - 1), F.concat(F.lit(" "), strip(F.substring(sentence, blank + 1, F.length(sentence))))
    options = F.transform(F.array(first, second), lambda o: F.struct(F.concat(before, o).alias("context"), tail.alias("continuation")))
    return F.when(blank > 0, _item(options, answer - 1))


def supported_choice(support: Column, question: Column, wrong: list[Column], right: Column) -> Column:
    """Three wrong options and the right one last, below an optional support."""
    context = strip(F.concat(_said(support), F.lit("\n"), _question(question)))
    return _item(_options(context, F.array(*wrong, right)), F.lit(len(wrong)))


def yes_or_no(passage: Column, question: Column, answer: Column) -> Column:
    context = F.concat(passage, F.lit("\nQuestion: "), question, F.lit("?\nAnswer:"))
    return _item(_options(context, F.array(F.lit("no"), F.lit("yes"))), answer.cast("int"))


def last_word(text: Column) -> Column:
    """The last word after the last space is what is scored; null if nothing stands on one side of it."""
    said = _said(text)
    word = F.substring_index(said, " ", -1)
    context = F.substring(said, F.lit(1), F.length(said) - F.length(word) - 1)
    return F.when((F.instr(said, " ") > 0) & (context != "") & (word != ""), _item(_options(context, F.array(word)), F.lit(0)))


def lettered_choice(subject: Column, question: Column, choices: Column, answer: Column) -> Column:
    """Letters after a question that lists its four choices; null if there aren't four."""
    listed = F.array_join(F.zip_with(F.array(*map(F.lit, LETTERS)), choices, lambda a, b: F.concat(a, F.lit(". "), b)), "\n")
    intro = F.concat(F.lit("The following are multiple choice questions (with answers) about "), F.replace(_said(subject), F.lit("_"), F.lit(" ")), F.lit(".\n\n"))
    context = F.concat(intro, question, F.lit("\n"), listed, F.lit("\nAnswer:"))
    return F.when(F.size(choices) == 4, _item(_options(context, F.array(*map(F.lit, LETTERS))), answer))


def open_question(question: Column, normalized: Column, aliases: Column, value: Column) -> Column:
    """(prompt, answers): the normalised aliases, else the aliases, and the value itself; null without any."""
    blank = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: strip(x) != "")
    said = F.when(F.size(blank(normalized)) > 0, blank(normalized)).otherwise(blank(aliases))
    answers = F.when(_said(value) != "", F.array_append(said, _said(value))).otherwise(said)
    return F.when(F.size(answers) > 0, F.struct(_question(question).alias("prompt"), answers.alias("answers")))


def short_question(question: Column, answers: Column) -> Column:
    """(prompt, answers) in the form ``Q: ... A:``; null without an answer that isn't blank."""
    said = F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda x: strip(x) != "")
    return F.when(F.size(said) > 0, F.struct(F.concat(F.lit("Q: "), question, F.lit("\n\nA:")).alias("prompt"), said.alias("answers")))


def number_question(question: Column, answer: Column) -> Column:
    """(prompt, answers): the number after the last ####, without commas."""
    gold = F.replace(strip(F.substring_index(answer, "####", -1)), F.lit(","), F.lit(""))
    return F.struct(_question(question).alias("prompt"), F.array(gold).alias("answers"))


def listed_answers(value: Column) -> Column:
    """The entries of a list written in a string, as JSON or with single quotes; any other text is one entry."""
    said = _said(value)
    quoted = F.regexp_extract_all(said, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    bare = F.transform(quoted, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
    is_list = said.rlike(r"(?s)^\[.*\]$")
    found = F.when(is_list, F.coalesce(F.from_json(said, "array<string>"), bare)).otherwise(F.array(said))
    return _full(found)


def popular_fact(subject: Column, relation: Column, value: Column, question: Column, popularity: Column, possible: Column) -> Column:
    """(subject, relation, object, question, answers, popularity); null if a part is blank or the popularity is no number."""
    parts = [_said(c) for c in (subject, relation, value, question)]
    number = popularity.cast("string").try_cast("double")
    usable = number.isNotNull()
    for p in parts:
        usable = usable & (p != "")
    answers = F.array_distinct(F.array_append(listed_answers(possible), parts[2]))
    return F.when(usable, F.struct(*(p.alias(n) for p, n in zip(parts, ("subject", "relation", "object", "question"), strict=True)), answers.alias("answers"), number.alias("popularity")))


def relation_class(relation: Column, entity: list[str], attribute: list[str]) -> Column:
    return F.when(relation.isin(*entity), "entity").when(relation.isin(*attribute), "attribute").otherwise("other")


def prior_question(question: Column, subject: Column) -> Column:
    """The question with X for the subject's whole words, ignoring case; null if the subject isn't in it."""
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace(subject, r"([^\p{L}\p{N} ])", r"\\$1"), F.lit(r"(?!\w)"))
    return F.when(F.regexp_count(question, pattern) > 0, F.regexp_replace(question, pattern, F.lit("X")))


def spanned(parts: Column) -> Column:
    """(text, spans) of parts (text, label) put together; a span is (start, end, label) of each part with a label, ends exclusive."""
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("spans"))
    width = lambda a: F.length(a["text"])
    step = lambda a, p: F.struct(
        F.concat(a["text"], p["text"]).alias("text"),
        F.when(p["label"].isNotNull(), F.array_append(a["spans"], F.struct(width(a).alias("start"), (width(a) + F.length(p["text"])).alias("end"), p["label"].alias("label")))).otherwise(a["spans"]).alias("spans"),
    )
    return F.aggregate(parts, start, step)


def biography(key: Column, name: Column, pronoun: Column, values: dict[str, Column], templates: dict[str, list[str]], seed: int = 42, shown: Column | None = None) -> Column:
    """(text, spans): a sentence for each attribute in a drawn order, each of a drawn template with ``{s}`` and ``{v}``.

    The first sentence names its subject, later ones do half of the time and else use the pronoun. The draws depend on the key alone, so
    other values or another name (``shown``) give the same structure. Spans label every value by its attribute and every name by ``name``.
    """
    name = name if shown is None else shown
    capital = F.concat(F.upper(F.substring(pronoun, 1, 1)), F.substring(pronoun, F.lit(2), F.length(pronoun)))
    nothing = F.lit(None).cast("string")
    part = lambda text, label: F.struct(text.alias("text"), label.alias("label"))

    def sentence(attribute: str, template: str, named: Column) -> Column:
        pieces, rest = [], template
        while rest:
            cut = min(at for at in (rest.find("{s}"), rest.find("{v}"), len(rest)) if at >= 0)
            if cut:
                pieces.append(part(F.lit(rest[:cut]), nothing))
            if cut < len(rest):
                opening = cut == 0 and not pieces
                said = F.when(named, name).otherwise(capital if opening else pronoun)
                pieces.append(part(said, F.when(named, F.lit("name")).otherwise(nothing)) if rest[cut : cut + 3] == "{s}" else part(values[attribute], F.lit(attribute)))
            rest = rest[cut + 3 :] if cut < len(rest) else ""
        return F.array(*pieces)

    drawn = []
    for attribute in values:
        place = draw(seed, key, F.lit(f"order:{attribute}"))
        chosen = F.floor(draw(seed, key, F.lit(f"template:{attribute}")) * len(templates[attribute])).cast("int")
        drawn.append(F.struct(place.alias("place"), F.lit(attribute).alias("attribute"), chosen.alias("chosen"), (draw(seed, key, F.lit(f"name:{attribute}")) < 0.5).alias("named")))

    def told(d: Column, i: Column) -> Column:
        named = (i == 0) | d["named"]
        found = F.array().cast("array<struct<text:string,label:string>>")
        for attribute, ways in templates.items():
            for k, way in enumerate(ways):
                found = F.when((d["attribute"] == attribute) & (d["chosen"] == k), sentence(attribute, way, named)).otherwise(found)
        return F.when(i > 0, F.concat(F.array(part(F.lit(" "), nothing)), found)).otherwise(found)

    return spanned(F.flatten(F.transform(F.array_sort(F.array(*drawn)), told)))


def chain_question(start: Column, phrases: list[str], question: str) -> Column:
    """A nested noun phrase: each ``{x}`` takes what was said so far, and the question takes the last."""
    said = start
    for way in [*phrases, question]:
        before, after = way.split("{x}")
        said = F.concat(F.lit(before), said, F.lit(after))
    return said


#: Fixed value: what opens the answer of a written chain.
MARKER = "Answer:"


def written_bridge(entities: Column) -> Column:
    """``Step 1: e1. Step 2: e2. Answer: ek.`` of the chain e0 to ek."""
    n = F.size(entities)
    steps = F.transform(F.slice(entities, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda e, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), e, F.lit(".")))
    return F.array_join(F.array_append(steps, F.concat(F.lit(f"{MARKER} "), F.element_at(entities, -1), F.lit("."))), " ")


def split_bridge(text: Column) -> Column:
    """(prefix, rest): the text through the first marker and a space, and what follows less one space; without a marker (text, null)."""
    at = F.instr(text, MARKER)
    end = at + len(MARKER) - 1
    rest = F.substring(text, end + 1, F.length(text))
    rest = F.when(F.startswith(rest, F.lit(" ")), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    return F.struct(F.when(at > 0, F.concat(F.substring(text, F.lit(1), end), F.lit(" "))).otherwise(text).alias("prefix"), F.when(at > 0, rest).alias("rest"))


def bridge_hits(text: Column, entities: Column) -> Column:
    """For each entity between the first and the last of a chain whether it stands in the text on word boundaries."""
    inner = F.slice(entities, F.lit(2), F.greatest(F.size(entities) - 2, F.lit(0)))
    quoted = lambda e: F.concat(F.lit(r"(?U)\b"), F.regexp_replace(e, r"([^\p{L}\p{N} ])", r"\\$1"), F.lit(r"\b"))
    return F.transform(inner, lambda e: F.regexp_count(text, quoted(e)) > 0)

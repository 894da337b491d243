"""Texts as reports and prompts show them: marked sentences and blocks of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.rules import choose
from lectern.functions.text import clean, once, tokens, truncated

#: A sentence with the white space that ends it; all pieces together are the text.
PIECE = r"(?s).+?(?:(?<=[.!?])\s+|\n+|\z)"
#: What HTML writes for its own letters, the first one first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
#: The most letters of each part of a block.
LONGEST = {"text_chunk": 1400, "table": 1800, "figure": 1400}


def escaped(c: Column) -> Column:
    for letter, entity in ENTITIES:
        c = F.replace(c, F.lit(letter), F.lit(entity))
    return c


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def best_sentence_at(raw: Column, claim: Column) -> Column:
    """sentence, score, start and end (letters of raw, from 0) of the first sentence that shares most words with a claim; no words shared: '', 0 and nulls."""
    raw, words = F.coalesce(raw, F.lit("")), tokens(claim)
    state = lambda at, sentence, hits, start: F.struct(at.cast("int").alias("at"), sentence.alias("sentence"), hits.cast("int").alias("hits"), start.cast("int").alias("start"))

    def step(x: Column, piece: Column) -> Column:
        sentence = stripped(piece)
        hits = F.size(F.array_intersect(tokens(sentence), words))
        at = x["at"] + F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
        after, better = x["at"] + F.length(piece), hits > x["hits"]
        return state(after, F.when(better, sentence).otherwise(x["sentence"]), F.greatest(hits, x["hits"]), F.when(better, at).otherwise(x["start"]))

    best = F.aggregate(F.regexp_extract_all(raw, F.lit(PIECE), F.lit(0)), state(F.lit(0), F.lit(""), F.lit(0), F.lit(None)), step)
    score = F.when(best["hits"] > 0, best["hits"] / F.sqrt(F.size(words))).otherwise(0.0)
    return F.struct(best["sentence"].alias("sentence"), score.alias("score"), best["start"].alias("start"), (best["start"] + F.length(best["sentence"])).alias("end"))


def marked(raw: Column, sentence: Column) -> Column:
    """HTML of a text with the first place of a sentence marked, if it has one."""
    raw, sentence = F.coalesce(raw, F.lit("")), stripped(F.coalesce(sentence, F.lit("")))
    at = F.call_function("locate", sentence, raw)
    before, after = F.substr(raw, F.lit(1), at - 1), F.substr(raw, at + F.length(sentence))
    return F.when((sentence == "") | (at == 0), escaped(raw)).otherwise(F.concat(escaped(before), F.lit("<mark>"), escaped(sentence), F.lit("</mark>"), escaped(after)))


def marked_all(raw: Column, hits: Column) -> Column:
    """HTML of a text with all hits (an array of start, end and label) marked; of those that overlap the earliest stays, then the longest.

    No hits (or null): the text alone. A null text counts as empty.
    """
    raw = F.coalesce(raw, F.lit(""))
    of = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("last"), h["label"].alias("label"))))

    def step(x: Column, h: Column) -> Column:
        end = -h["last"]
        more = F.concat(
            x["html"], escaped(F.substr(raw, x["at"] + 1, h["start"] - x["at"])), F.lit("<mark>["), h["label"], F.lit("] "),
            escaped(F.substr(raw, h["start"] + 1, end - h["start"])), F.lit("</mark>"),
        )
        fits = h["start"] >= x["at"]
        return F.struct(F.when(fits, more).otherwise(x["html"]).alias("html"), F.when(fits, end).otherwise(x["at"]).alias("at"))

    return F.coalesce(F.aggregate(of, F.struct(F.lit("").alias("html"), F.lit(0).alias("at")), step, lambda x: F.concat(x["html"], escaped(F.substr(raw, x["at"] + 1)))), escaped(raw))


def _listed(head: str, items: Column, most: int) -> Column:
    """A heading and at most so many items, or null without any."""
    lines = F.transform(F.slice(items, 1, most), lambda s: F.concat(F.lit("- "), truncated(s, 150)))
    return F.when(F.size(items) > 0, F.concat_ws("\n", F.lit(head), lines))


def _figure(figure: Column, semantics: Column, ocr: Column) -> Column:
    """What was read in a figure, line by line, or null."""
    part = lambda head, c, n: F.concat(F.lit(head), F.nullif(truncated(F.coalesce(c, F.lit("")), n), F.lit("")))
    lines = F.array(
        part("Figure summary: ", semantics["figure_summary"], 300), _listed("Key observations:", semantics["key_observations"], 3),
        _listed("Possible verification use:", semantics["possible_verification_use"], 2), F.when(semantics["needs_precise_ocr"], "Needs precise OCR: yes"), part("Figure text (OCR):\n", ocr, LONGEST["figure"]),
    )
    return F.when(figure, F.nullif(F.array_join(lines, "\n"), F.lit("")))


def evidence_item(rank: Column, kind: Column, section: Column, page: Column, label: Column, matched: Column, boost: Column, caption: Column, text: Column, ocr: Column, semantics: Column) -> Column:
    """A piece of evidence as a prompt shows it. What is null or empty has no line; semantics: a struct of figure_summary,
    key_observations, possible_verification_use and needs_precise_ocr, shown for figures."""
    kind = F.when(kind.isin("table", "figure"), kind).otherwise("text_chunk")
    full = lambda c: F.nullif(clean(F.coalesce(c, F.lit(""))), F.lit(""))
    named = lambda head, c: F.concat(F.lit(head), c)  # noqa: E731 - null where c is
    figure, shown = kind == "figure", kind != "text_chunk"
    name = choose((kind == "table", "Table"), (kind == "figure", "Figure"), other="Text")
    none = choose((kind == "table", "(No extracted table text available)"), (kind == "figure", "(No extracted figure context available)"), other="(No text available)")
    body = choose(*((kind == k, truncated(F.coalesce(text, F.lit("")), n)) for k, n in LONGEST.items()))
    return F.concat_ws(
        "\n", F.concat(F.lit("[Evidence E"), rank.cast("string"), F.lit(" | Type: "), name, F.lit("]")), named("Section: ", F.coalesce(full(section), F.lit("unknown"))),
        named("Page: ", F.coalesce(F.nullif(page, F.lit(0)).cast("string"), F.lit("?"))), named("Label: ", full(label)),
        F.when(matched, "Reference match: yes").when(boost > 0, named("Reference boost: ", F.format_string("%.2f", boost))), F.when(shown, named("Caption:\n", full(caption))),
        _figure(figure, semantics, ocr),
        F.lit("Content:"), once(body, lambda t: F.coalesce(F.nullif(t, F.lit("")), none)),
    )


def evidence_block(items: Column) -> Column:
    """All items of a claim; without any a remark."""
    return F.when(F.size(items) > 0, F.array_join(items, "\n\n")).otherwise("(No evidence items retrieved.)")


def joined_labels(numbers: Column) -> Column:
    """Claims' numbers as labels: C1,C3."""
    return F.array_join(F.transform(F.array_sort(numbers), lambda n: F.concat(F.lit("C"), n.cast("string"))), ",")


#: The kinds of figures that an answer may name.
FIGURE_TYPES = ("bar_chart", "line_chart", "scatter_plot", "heatmap", "qualitative_examples", "architecture_diagram", "workflow_diagram", "table_like_visual", "other")
#: Values that an answer leaves empty, as JSON.
_EMPTY = ("", "null", "false", "0", "0.0", "[]", "{}")


def figure_answer(raw: Column) -> Column:
    """What a model says of a figure: figure_type, figure_summary, key_observations, possible_verification_use, needs_precise_ocr.

    The answer is a JSON object, maybe in a code fence or with words around it; without one, or where a field is missing or of
    another kind, the field has its default ('other', '', no items, false). Texts are cut to 400 and 200 letters, lists to the
    first three and two items; items that are empty are left out then.
    """
    fields = ("figure_type", "figure_summary", "key_observations", "possible_verification_use", "needs_precise_ocr")
    schema = ", ".join(f"{f} string" for f in fields) + ", _broken string"
    bare = stripped(F.regexp_replace(F.regexp_replace(stripped(F.coalesce(raw, F.lit(""))), r"^(?i:```(?:json)?)\s*", ""), r"\s*```$", ""))
    parsed = lambda c: F.from_json(c, schema, {"columnNameOfCorruptRecord": "_broken"})
    first = parsed(bare)
    good = lambda x: x["_broken"].isNull() & x.isNotNull()
    data = F.when(good(first) & bare.startswith("{"), first).otherwise(parsed(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))
    field = lambda f: F.when(good(data), data[f])
    given = lambda f: F.when(~F.coalesce(field(f), F.lit("")).isin(*_EMPTY), field(f))
    kind = F.lower(stripped(F.coalesce(given("figure_type"), F.lit("other"))))
    cut = lambda c, n: F.left(stripped(c), F.lit(n))

    def items(f: str, most: int) -> Column:
        listed = F.when(field(f).startswith("["), F.from_json(field(f), "array<string>"))
        kept = F.filter(F.slice(listed, 1, most), lambda x: ~F.coalesce(x, F.lit("")).isin(*_EMPTY))
        return F.coalesce(F.transform(kept, lambda x: cut(x, 200)), F.array().cast("array<string>"))

    return F.struct(
        F.when(kind.isin(*FIGURE_TYPES), kind).otherwise("other").alias("figure_type"), cut(F.coalesce(given("figure_summary"), F.lit("")), 400).alias("figure_summary"), items("key_observations", 3).alias("key_observations"),
        items("possible_verification_use", 2).alias("possible_verification_use"), F.coalesce(F.lower(stripped(field("needs_precise_ocr"))).isin("true", "yes", "1"), F.lit(False)).alias("needs_precise_ocr"),
    )

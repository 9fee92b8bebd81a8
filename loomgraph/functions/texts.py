"""Text rules as Column expressions: definitions, coverage of beats, names, replies, prices, prose around beats.

A null text counts as empty, unless a function says otherwise. Words and their bounds are those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

# Phrases that define a word; openings of an answer that is no prose; words that give a name its group;
# words that open a sentence; definitions for words without one.
DEFINITIONS = [r"\bmeans\b", r"\bis when\b", r"\bis to\b", r"\bis a\b", r"to \w+ is to", r"called\b"]
NEAR_WORD = [r"\b{w}\b[^.]*\bmeans\b", r"\bmeans\b[^.]*\b{w}\b", r"\bto\s+{w}\b[^.]*\bis\b", r"\b{w}\b[^.]*\bis when\b", r"\ba\s+{w}\b\s+is\b",
             r"\b{w}\b[^.]*\bis to\b", r"\b{w}\b[^.—]*—[^.]*\b(to|a|the)\b", r"\bto\s+{w}\s+is\s+to\b"]
OPENINGS = ["let me", "here is", "i'll write"]
OFFICES = ["Office", "Bureau", "Department", "District", "Agent", "Director"]
PLACES = ["Street", "Plaza", "Tower", "Hall", "Quarter"]
OPENERS = ["The", "This", "That", "What", "When", "Where", "Why", "How", "It", "He", "She", "They", "We", "I"]
BY_POS = {"n": "a type of thing or concept", "v": "to do or perform an action", "j": "a quality or characteristic", "r": "in a certain way or manner"}


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def reply_function(text: Column, place: Column) -> Column:
    """Function of a beat by a question mark, words of assent or refusal, and whether it opens the walk (place 0)."""
    low = F.lower(_text(text))
    rules = [(low.contains("?"), "query"), (S.has_any(low, ["yes", "sure", "okay"]), "comply"), (S.has_any(low, ["no", "refuse"]), "refuse"), (place == 0, "deliver_information")]
    return S.ordered([(test, F.lit(name)) for test, name in rules], F.lit("react"))


def barrier_of(emotions: Column) -> Column:
    return F.when(F.array_contains(emotions, "anger"), "confrontation").otherwise("ambient")


def shape_of_barrier(barrier: Column) -> Column:
    return F.when(barrier == "confrontation", "escalating_threat").otherwise("information_dump")


def arc_by_function(emotions: Column, functions: Column) -> Column:
    """Arc shape by the first and last emotion, then by a function that occurs; without beats escalating_threat."""
    first, last = F.get(emotions, F.lit(0)), F.get(emotions, F.size(emotions) - 1)
    rules = [
        (F.size(emotions) == 1, "single_beat"),
        ((first == "neutral") & last.isin("anger", "fear"), "escalating_threat"),
        (first.isin("anger", "fear") & (last == "neutral"), "de_escalation"),
        (F.array_contains(functions, "negotiate"), "negotiation_arc"),
        (F.array_contains(functions, "plead"), "plea_arc"),
        (F.array_contains(functions, "bark"), "ambient_chatter"),
    ]
    return S.ordered([(test, F.lit(name)) for test, name in rules], F.lit("escalating_threat"))


def named_phrases(text: Column) -> Column:
    """Runs of capitalised words of more than three letters in all, each once; sentence openers alone are left out."""
    found = F.array_distinct(F.regexp_extract_all(_text(text), F.lit(r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1))
    return F.filter(found, lambda n: (F.length(n) > 3) & ~n.isin(OPENERS))


def name_group(name: Column) -> Column:
    return F.when(S.has_any(name, OFFICES), "bureaucratic_entities").when(S.has_any(name, PLACES), "locations").otherwise("characters")


def walk_used(beats: Column, prose: Column) -> Column:
    """Whether the prose holds half the words of a beat of more than 15 characters, as substrings."""
    low = F.lower(_text(prose))

    def used(beat: Column) -> Column:
        text = F.lower(S.clean_text(_text(beat)))
        words = S.words_of(text)
        return (F.length(text) > 15) & (F.size(F.filter(words, lambda w: low.contains(w))) * 2 >= F.size(words))

    return F.coalesce(F.exists(beats, used), F.lit(False))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"(?U)(\w+)"), 1))


def defines(text: Column) -> Column:
    """Whether some phrase of the text defines anything."""
    low = F.lower(_text(text))
    out = F.lit(False)
    for pattern in DEFINITIONS:
        out = out | low.rlike("(?U)" + pattern)
    return out


def plain(text: Column) -> Column:
    """Text without bold and slanted marks of asterisks."""
    return F.regexp_replace(F.regexp_replace(_text(text), r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1")


def word_defined(text: Column, word: Column, forms: Column) -> Column:
    """Whether a form of the word stands in the text and the word itself (letters only) next to a defining phrase."""
    low = F.lower(plain(text))
    near = F.lit(False)
    for pattern in NEAR_WORD:
        near = near | F.regexp_like(low, F.replace(F.lit("(?U)" + pattern), F.lit("{w}"), word))
    return F.arrays_overlap(tokens(low), forms) & near


def fable_reason(prose: Column, walks_used: Column, words_defined: Column, least_walks: int = 4, least_words: int = 5, cleaned: bool = False) -> Column:
    """Reason against a text that should use walks and define words, or null."""
    words, low = F.size(S.words_of(_text(prose))), F.lower(_text(prose))
    rules = [(words < 80, F.lit("too_short")), (words > 600, F.lit("too_long"))]
    if not cleaned:
        rules += [(low.contains(m), F.lit("meta_" + m.replace(" ", "_"))) for m in S.META[:6]]
    rules += [
        (walks_used < least_walks, F.concat(F.lit("insufficient_walks_"), walks_used.cast("string"))),
        (words_defined < least_words, F.concat(F.lit("insufficient_definitions_"), words_defined.cast("string"))),
    ]
    return S.ordered(rules, F.lit(None).cast("string"))


def _unfenced(text: Column) -> Column:
    """Text without a fence of three back-ticks at its start and end."""
    return F.regexp_replace(F.regexp_replace(F.trim(_text(text)), r"^```\w*\n?", ""), r"\n?```$", "")


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_of(text: Column) -> Column:
    """What stands in a json fence, else the text where it is JSON, else the text as raw_response of an object."""
    fenced = F.regexp_extract(_text(text), r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(_text(text).contains("```json") & (fenced != ""), fenced).when(_is_json(_text(text)), text).otherwise(F.to_json(F.struct(_text(text).alias("raw_response"))))


def payload(raw: Column, reply: Column) -> Column:
    """Struct (prose, error, notes) of a cleaner's JSON reply about a raw text.

    A raw text under 50 characters is empty. A reply that is no JSON lets the raw text stand if it has more than 100
    characters and its first 50 hold none of the usual openings, else it is malformed.
    """
    body = _unfenced(reply)
    field = lambda name: F.get_json_object(body, f"$.{name}")
    none = F.lit(None).cast("string")
    out = lambda prose, error, notes: F.struct(prose.alias("prose"), error.alias("error"), notes.alias("notes"))
    salvage = (F.length(raw) > 100) & ~S.has_any(F.substring(F.lower(raw), 1, 50), OPENINGS)
    return (
        F.when(F.length(_text(raw)) < 50, out(none, F.lit("empty"), none))
        .when(~F.coalesce(_is_json(body), F.lit(False)) & salvage, out(raw, none, F.lit("json_parse_failed_using_raw")))
        .when(~F.coalesce(_is_json(body), F.lit(False)), out(none, F.lit("malformed"), none))
        .when(F.coalesce(field("error"), F.lit("")) != "", out(none, field("error"), field("notes")))
        .when(F.length(field("prose")) > 50, out(field("prose"), none, field("notes")))
        .otherwise(out(none, F.lit("empty"), field("notes")))
    )


def definition(known: Column, pos: Column, most: int = 100) -> Column:
    """A known definition in lower case, cut after its last whole word within ``most`` characters, or one by part of speech."""
    low = F.lower(known)
    head = F.substring(low, 1, most)
    cut = F.when(F.length(low) > most, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("..."))).otherwise(low)
    return F.coalesce(F.when(F.length(known) > 0, cut), S.code_name(pos, BY_POS, "a word"))


def curator_due(pending: Column, progress: Column, total: Column, threshold: int = 10) -> Column:
    """Whether additions are to be judged now: enough wait, or, early in a run, any at each third translation."""
    return (pending >= threshold) | ((progress < 0.3) & (pending > 0) & (total % 3 == 0))


def token_cost(model: Column, read: Column, written: Column, prices: dict[str, tuple[float, float]], other: tuple[float, float] = (3.0, 15.0)) -> Column:
    """Cost of tokens read and written, at prices for a million by model."""
    price = lambda side: S.code_name(model, {m: p[side] for m, p in prices.items()}, F.lit(other[side]))
    return (read * price(0) + written * price(1)) / F.lit(1e6)


def attribution(emotion: Column, speaker: Column, place: Column, verbs: dict[str, list[str]]) -> Column:
    """``speaker verb``, the verb by emotion (neutral for others) and place."""
    table = F.create_map(*(x for e, v in verbs.items() for x in (F.lit(e), F.array(*map(F.lit, v)))))
    choice = F.coalesce(F.try_element_at(table, emotion), table["neutral"])
    return F.concat(speaker, F.lit(" "), F.get(choice, (place % F.size(choice)).cast("int")))


def action_beat(before: Column, now: Column, speaker: Column, beats: dict[tuple[str, str], list[str]], key: Column) -> Column:
    """A sentence with the speaker's name for a change of emotion, drawn by key; null where there is none."""
    table = F.create_map(*(x for (a, b), v in beats.items() for x in (F.lit(f"{a}>{b}"), F.array(*map(F.lit, v)))))
    choice = F.try_element_at(table, F.concat_ws(">", before, now))
    picked = F.get(choice, F.floor(S.draw(F.lit("action"), key) * F.size(choice)).cast("int"))
    return F.when(before.isNotNull() & now.isNotNull(), F.replace(picked, F.lit("{speaker}"), F.initcap(speaker)))


def spoken(text: Column, said: Column, place: Column) -> Column:
    """A beat as speech: who said it stands before, after or inside it, in turn by place."""
    clean = S.clean_text(_text(text))
    first, second = F.substring_index(clean, ".", 1), F.trim(F.regexp_replace(clean, r"^[^.]*\.?", ""))
    after = F.concat(F.lit('"'), clean, F.lit('" '), said, F.lit("."))
    inside = F.concat(F.lit('"'), first, F.lit('," '), said, F.lit('. "'), second, F.lit('"'))
    return F.when(place % 3 == 0, F.concat(said, F.lit(', "'), clean, F.lit('"'))).when((place % 3 == 2) & (F.length(clean) > 30) & (second != ""), inside).otherwise(after)


def prose(beats: Column, setup: Column, speakers: Column, verbs: dict[str, list[str]], contexts: dict[str, str]) -> Column:
    """A walk (array of text, emotion, function, speaker) as paragraphs after a scene; unnamed speakers take turns."""

    def paragraph(b: Column, i: Column) -> Column:
        who = F.coalesce(F.when(b["speaker"] != "", b["speaker"]), F.get(speakers, (i % 2).cast("int")))
        return F.concat(S.code_name(b["function"], contexts, ""), spoken(b["text"], attribution(b["emotion"], F.initcap(who), i, verbs), i))

    return F.array_join(F.concat(F.array(setup), F.transform(beats, paragraph)), "\n\n")


def walk_context(beats: Column, fields: dict[str, str]) -> Column:
    """Lines ``label: values`` of the distinct values of a walk's beats, in their order; null without any."""

    def line(field: str, label: str) -> Column:
        values = F.array_distinct(F.filter(F.transform(beats, lambda b: b[field]), lambda v: v.isNotNull() & (v != "")))
        return F.when(F.size(values) > 0, F.concat(F.lit(label + ": "), F.array_join(values, ", ")))

    lines = [line(field, label) for field, label in fields.items()]
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def setting_spec(spec: Column) -> Column:
    """Struct (setting, version) of ``name:4`` or ``name``."""
    parts = F.split(spec, ":")
    return F.struct(F.get(parts, F.lit(0)).alias("setting"), F.get(parts, F.lit(1)).try_cast("int").alias("version"))


def excerpt(text: Column, titles: dict[str, str], each: int = 800, most: int = 2000) -> Column:
    """Top-level sections of a YAML text by name, each under its title and cut at ``each`` characters; null without any."""
    parts = []
    for name, title in titles.items():
        body = F.regexp_extract(_text(text), rf"(?s){name}:(.*?)(?=\n[a-z_]+:|\z)", 1)
        parts.append(F.when(_text(text).contains(name + ":"), F.concat(F.lit(f"## {title}\n"), F.substring(body, 1, each))))
    return F.nullif(F.substring(F.concat_ws("\n\n", *parts), 1, most), F.lit(""))


def scored_sample(text: Column, question: str) -> Column:
    """A text with the question that a scoring head is asked about it."""
    return F.concat(F.lit("Text:\n"), _text(text), F.lit("\n\n" + question))

"""Scalar operators as Column expressions; no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Emotions, their variants, and how well one follows another.
CANONICAL = ["anger", "disgust", "fear", "happy", "neutral", "sad", "surprise"]
VARIANTS = {
    "fear": "alarm, alarmed, anxiety, anxious, apprehension, apprehensive, bureaucratic_dread, concern, concerned, dawning horror, dawning_horror, distress, distressed, dread, frightened, intimidated, nervous, paranoia, paranoid, scared, terror, trepidation, unease, uneasy, warning, worried, worry",
    "anger": "accusatory, aggression, aggressive, angry, annoyance, annoyed, controlled_anger, defensive, defiance, defiant, frustrated, frustration, furious, fury, hostile, hostility, indignant, indignation, irritated, irritation, outrage, outraged, rage, resentful, resentment, threatening",
    "sad": "anguish, anguished, beaten resignation, cynical_resignation, dejected, dejection, despair, despairing, disappointed, disappointment, exhausted, giving up, grief, grieving, hopeless, hopelessness, hurt, melancholy, pained, regret, regretful, resignation, resigned, resigned_acceptance, sorrow, sorrowful, suffering, tired, tormented, weariness, weary, wounded",
    "disgust": "aversion, contempt, contemptuous, disdain, disdainful, dismissive, distaste, exasperated, exasperation, loathing, mocking, repulsed, revulsion, scorn, scornful",
    "happy": "amused, amusement, content, contentment, delight, delighted, eager, enthusiasm, enthusiastic, excited, excitement, hope, hopeful, joy, joyful, pleased, pleasure, relief, relieved, satisfaction, satisfied",
    "surprise": "amazed, amazement, astonished, astonishment, bewildered, bewilderment, disbelief, realization, shock, shocked, startled, stunned, surprised",
    "neutral": "analytical, businesslike, calculating, calm, caution, cautious, cold, cold_formality, composed, confident, confused, confusion, contemplation, contemplative, curiosity, curious, detached, determined, flat, formal, guarded, impassive, indifferent, interest, interested, intrigued, matter-of-fact, measured, monotone, neutral_with_hint, pensive, professional, reflective, reserved, serious, stern, stoic, suspicion, suspicious, thoughtful, uncertain, uncertainty, unsure, urgent, wary",
}
FOLLOWS = {
    "neutral": {"neutral": 1.0, "happy": 0.8, "sad": 0.7, "anger": 0.6, "fear": 0.6, "surprise": 0.7, "disgust": 0.5},
    "happy": {"happy": 1.0, "neutral": 0.8, "surprise": 0.7},
    "sad": {"sad": 1.0, "neutral": 0.7},
    "anger": {"anger": 1.0, "neutral": 0.6, "disgust": 0.7},
    "fear": {"fear": 1.0, "neutral": 0.6, "surprise": 0.6},
    "surprise": {"surprise": 1.0, "neutral": 0.7},
    "disgust": {"disgust": 1.0, "anger": 0.7, "neutral": 0.5},
}
# Condition codes.
FUNCTION_NAMES = {14: "GetActorValue", 38: "GetQuestRunning", 43: "GetStage", 56: "GetDisposition", 60: "GetRandomPercent", 70: "GetIsSex", 72: "GetIsID", 73: "GetFactionRank", 77: "GetIsRace", 79: "GetStage", 117: "GetInCell", 161: "GetQuestCompleted"}
COMPARISONS = {0: "==", 1: "!=", 2: ">", 3: ">=", 4: "<", 5: "<="}
RUN_ON = {0: "subject", 1: "target", 2: "reference", 3: "combat_target"}
# Word lists of the ordered rules.
CATEGORIES = [
    ("GREETING", ["greeting", "hello"]), ("FAREWELL", ["goodbye", "farewell", "bye"]), ("COMBAT", ["attack", "combat", "fight", "hostile"]),
    ("TRADE", ["trade", "barter", "buy", "sell", "shop"]), ("RUMORS", ["rumor", "news", "gossip"]), ("QUEST", ["quest", "task", "mission", "job"]),
    ("AMBIENT", ["idle", "ambient"]), ("SERVICE", ["service", "train", "repair"]), ("COMPANION", ["follow", "wait", "dismiss"]), ("CRIME", ["crime", "bounty", "arrest", "guard"]),
]
OBLIGE, PLEAD, CLOCK = ["should", "must", "need to", "will"], ["please", "help", "mercy", "sorry"], ["time's up", "day", "hour", "minute"]
ASSENT, REFUSAL = ["yes", "agreed", "ok", "will do"], ["no", "refuse", "won't", "can't"]
ASKING, PARTING = ["what", "who", "where", "when", "why", "how"], ["goodbye", "farewell", "later", "see you"]
AUTHORITY, MERCHANT = ["ranger", "guard", "officer", "sergeant", "commander", "chief"], ["merchant", "trader", "vendor", "bartender"]
COUNTDOWN, CONFRONTATION, NEGOTIATION = ["day", "hour", "time", "left", "expired", "up"], ["should have", "could have", "would have"], ["offer", "deal", "agree", "terms"]
META = ["as an ai", "i'll write", "i will write", "here is", "here's the", "let me", "i'd be happy", "i cannot", "i can't"]
HUB_TOPICS = ["GREETING", "HELLO", "GOODBYE", "BYE", "YOURDEFAULTTOPIC", "YOURDEFAULTTOPIC2", "INFOGENERAL"]


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds one of the words as a substring."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def ordered(rules: list[tuple[Column, Column | str | None]], other) -> Column:
    """The value of the first rule that holds, else ``other``."""
    (when, value), *rest = rules
    out = F.when(when, value)
    for when, value in rest:
        out = out.when(when, value)
    return out.otherwise(other)


def code_name(code: Column, names: dict[int, str], other: Column | str) -> Column:
    return ordered([(code == k, F.lit(v)) for k, v in names.items()], other if isinstance(other, Column) else F.lit(other))


def variant_pairs() -> dict[str, str]:
    return {v: emotion for emotion, words in VARIANTS.items() for v in words.split(", ")}


def clean_emotion(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def canonical_emotion(raw: Column, default: str = "neutral") -> Column:
    """A canonical emotion as it is, a variant as its canonical one, anything else the default."""
    clean = clean_emotion(raw)
    table = F.create_map(*(F.lit(x) for pair in variant_pairs().items() for x in pair))
    return F.when(clean.isin(CANONICAL), clean).otherwise(F.coalesce(F.try_element_at(table, clean), F.lit(default)))


def emotion_status(raw: Column) -> Column:
    """valid, mapped or defaulted."""
    clean = clean_emotion(raw)
    return F.when(clean.isin(CANONICAL), "valid").when(clean.isin(list(variant_pairs())), "mapped").otherwise("defaulted")


def compatibility(first: Column, second: Column) -> Column:
    """How well the second emotion follows the first: the table, else nine tenths of the reverse, else 0.4."""
    table = F.create_map(*(F.lit(x) for a, row in FOLLOWS.items() for b, v in row.items() for x in (f"{a}>{b}", v)))
    at = lambda a, b: F.try_element_at(table, F.concat(F.lower(a), F.lit(">"), F.lower(b)))
    return F.coalesce(at(first, second), at(second, first) * F.lit(0.9), F.lit(0.4))


def topic_category(topic: Column) -> Column:
    t = F.lower(topic)
    return ordered([(has_any(t, words), F.lit(name)) for name, words in CATEGORIES], F.lit(None).cast("string"))


def beat_function(text: Column, emotion: Column) -> Column:
    t = F.lower(text)
    return ordered(
        [
            (has_any(t, OBLIGE) & emotion.isin("anger", "threat"), F.lit("threaten")),
            (has_any(t, PLEAD), F.lit("plead")),
            (has_any(t, CLOCK) & emotion.isin("anger", "neutral"), F.lit("react")),
            (has_any(t, ASSENT), F.lit("comply")),
            (has_any(t, REFUSAL), F.lit("refuse")),
            (has_any(t, ASKING), F.lit("query")),
            (has_any(t, PARTING), F.lit("farewell")),
            ((emotion == "neutral") & (F.length(text) < 40), F.lit("bark")),
            (emotion.isin("anger", "disgust"), F.lit("threaten")),
        ],
        F.lit("deliver_information"),
    )


def archetype_relation(speaker: Column) -> Column:
    s = F.lower(speaker)
    return ordered([(has_any(s, AUTHORITY), F.lit("authority_to_subject")), (has_any(s, MERCHANT), F.lit("merchant_to_customer"))], F.lit("stranger_to_stranger"))


def barrier_type(text: Column) -> Column:
    t = F.lower(text)
    return ordered([(has_any(t, COUNTDOWN), F.lit("countdown")), (has_any(t, CONFRONTATION), F.lit("confrontation")), (has_any(t, NEGOTIATION), F.lit("negotiation"))], F.lit("ambient"))


def arc_stats(emotions: Column) -> Column:
    """Arc shape by intensity of the distinct emotions in the order of their first use."""
    u = F.array_distinct(emotions)
    level = F.transform(u, lambda e: F.when(e.isin("fear", "anger", "disgust"), 2).when(e.isin("happy", "sad", "surprise"), 1).otherwise(0))
    steps = F.zip_with(F.slice(level, 1, F.size(level) - 1), F.slice(level, 2, F.size(level) - 1), lambda a, b: b - a)
    ends = F.concat(F.element_at(u, 1), F.lit("_to_"), F.element_at(u, -1))
    kind = F.when(F.forall(steps, lambda d: d >= 0), "escalation_").when(F.forall(steps, lambda d: d <= 0), "de_escalation_").otherwise("mixed_")
    return F.when(F.size(emotions) < 2, "single").when(F.size(u) == 1, F.concat(F.lit("flat_"), F.element_at(u, 1))).otherwise(F.concat(kind, ends))


def arc_transition(emotions: Column) -> Column:
    u = F.array_distinct(emotions)
    return F.when(F.size(emotions) < 2, "single").when(F.size(u) == 1, F.concat(F.lit("flat_"), F.element_at(u, 1))).otherwise(F.concat(F.lit("transition_"), F.element_at(u, 1), F.lit("_to_"), F.element_at(u, -1)))


def arc_prose(emotions: Column) -> Column:
    """Arc shape of a walk, by ordered rules."""
    first, last, n = F.element_at(emotions, 1), F.element_at(emotions, -1), F.size(emotions)
    share = F.size(F.filter(emotions, lambda e: e == "neutral")) / n
    return (
        F.when(n == 0, "information_exchange")
        .when(F.array_contains(F.slice(emotions, F.greatest(n - 1, F.lit(1)), 2), "anger") & (first == "neutral"), "escalating_threat")
        .when((last == "neutral") & F.array_contains(F.slice(emotions, 1, 2), "anger"), "de_escalation")
        .when(share >= 0.7, "information_exchange")
        .when(F.array_contains(emotions, "fear") | F.array_contains(emotions, "sad"), "supplication")
        .when(F.array_contains(emotions, "surprise"), "revelation")
        .otherwise("information_exchange")
    )


def clean_text(text: Column) -> Column:
    """Without stage tags such as {Hopeful}."""
    return F.trim(F.regexp_replace(text, r"\{[A-Za-z]+\}\s*", ""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)


def reading_grade(text: Column) -> Column:
    """Grade from words, sentence ends and vowels; null for texts without words."""
    words = F.size(words_of(text))
    sentences = F.greatest(F.lit(1), F.length(text) - F.length(F.regexp_replace(text, "[.!?]", "")))
    vowels = F.length(text) - F.length(F.regexp_replace(text, "[aeiouAEIOU]", ""))
    return F.when(words > 0, F.lit(0.39) * words / sentences + F.lit(11.8) * vowels / words - F.lit(15.59))


def inflections(word: Column, pos: Column) -> Column:
    """Regular forms of a lemma by part of speech (n, v, j, r)."""
    end = lambda *tails: F.lit(False) if not tails else word.rlike("(" + "|".join(tails) + ")$")
    y = word.rlike("[^aeiou]y$")
    stem_y, stem_e = F.regexp_replace(word, "y$", ""), F.regexp_replace(word, "e$", "")
    s = F.when(y, F.concat(stem_y, F.lit("ies"))).when(end("s", "x", "z", "ch", "sh"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    ed = F.when(end("e"), F.concat(word, F.lit("d"))).when(y, F.concat(stem_y, F.lit("ied"))).otherwise(F.concat(word, F.lit("ed")))
    ing = F.when(end("e") & ~end("ee"), F.concat(stem_e, F.lit("ing"))).otherwise(F.concat(word, F.lit("ing")))
    more = lambda t: F.when(end("e"), F.concat(stem_e, F.lit(t))).when(y, F.concat(stem_y, F.lit("i" + t))).otherwise(F.concat(word, F.lit(t)))
    ly = F.when(y, F.concat(stem_y, F.lit("ily"))).otherwise(F.concat(word, F.lit("ly")))
    forms = F.when(pos == "v", F.array(word, s, ed, ing)).when(pos == "n", F.array(word, s)).when(pos == "j", F.array(word, more("er"), more("est"), ly)).otherwise(F.array(word))
    return F.array_distinct(forms)


def warm_up(progress: Column, most: int = 25) -> Column:
    """Work allowed at a stage of a run, by a logistic curve."""
    return F.greatest(F.lit(2), F.floor(F.lit(float(most)) / (F.lit(1.0) + F.exp(F.lit(-10.0) * (progress - F.lit(0.3)))))).cast("int")


def draw(*parts: Column) -> Column:
    """A uniform number from a key: the same on every engine that has SHA-256."""
    key = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296)


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)

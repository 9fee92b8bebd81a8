import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S


def value(spark, expr, **columns):
    rows = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in columns.items()))
    return rows.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("raw,emotion,status", [("Bureaucratic_Dread ", "fear", "mapped"), ("cosmic_horror", "neutral", "defaulted"), ("Anger", "anger", "valid"), ("pained", "sad", "mapped")])
def test_emotions(spark, raw, emotion, status):
    assert value(spark, S.canonical_emotion(F.col("a")), a=raw) == emotion
    assert value(spark, S.emotion_status(F.col("a")), a=raw) == status


@pytest.mark.parametrize("a,b,score", [("anger", "disgust", 0.7), ("surprise", "happy", 0.63), ("fear", "anger", 0.4)])
def test_compatibility(spark, a, b, score):
    assert value(spark, S.compatibility(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(score)


@pytest.mark.parametrize(
    "emotions,shape",
    [(["neutral"], "single"), (["neutral", "neutral"], "flat_neutral"), (["neutral", "anger", "neutral"], "escalation_neutral_to_anger"), (["anger", "neutral"], "de_escalation_anger_to_neutral"), (["happy", "neutral", "anger"], "mixed_happy_to_anger"), (["happy", "sad"], "escalation_happy_to_sad")],
)
def test_arcs(spark, emotions, shape):
    assert value(spark, S.arc_stats(F.col("a")), a=emotions) == shape


def test_other_arcs(spark):
    assert value(spark, S.arc_transition(F.col("a")), a=["neutral", "anger", "neutral"]) == "transition_neutral_to_anger"
    assert value(spark, S.arc_prose(F.col("a")), a=["neutral", "anger"]) == "escalating_threat"
    assert value(spark, S.arc_prose(F.col("a")), a=["anger", "neutral"]) == "de_escalation"
    assert value(spark, S.arc_prose(F.col("a")), a=["neutral", "neutral", "neutral", "fear"]) == "information_exchange"


def test_beats(spark):
    assert value(spark, S.beat_function(F.col("a"), F.col("b")), a="I know", b="happy") == "refuse"
    assert value(spark, S.beat_function(F.col("a"), F.col("b")), a="Please go", b="neutral") == "plead"


def test_texts(spark):
    assert value(spark, S.clean_text(F.col("a")), a="{Hopeful} Hi") == "Hi"
    assert value(spark, S.reading_grade(F.col("a")), a="The cat sat. The dog ran!") == pytest.approx(-2.62)
    assert value(spark, S.reading_grade(F.col("a")), a="") is None
    assert value(spark, S.topic_category(F.col("a")), a="QuestGreeting") == "GREETING"
    assert value(spark, S.topic_category(F.col("a")), a="Jobless") == "QUEST"
    assert value(spark, S.topic_category(F.col("a")), a="Xyz") is None


@pytest.mark.parametrize("word,pos,forms", [("carry", "v", ["carry", "carries", "carried", "carrying"]), ("box", "n", ["box", "boxes"]), ("happy", "j", ["happy", "happier", "happiest", "happily"])])
def test_inflections(spark, word, pos, forms):
    assert value(spark, S.inflections(F.col("a"), F.col("b")), a=word, b=pos) == forms


@pytest.mark.parametrize("p,most", [(0.0, 2), (0.3, 12), (1.0, 24)])
def test_warm_up(spark, p, most):
    assert value(spark, S.warm_up(F.col("a")), a=p) == most

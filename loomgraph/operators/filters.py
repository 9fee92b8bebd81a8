"""Ordered text filters for training records: the first rule that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as T


def word_count(text: Column) -> Column:
    return F.size(S.words_of(text))


def preserved(beats: Column, prose: Column) -> Column:
    """Share of beats half of whose words the prose holds as substrings; a beat without words is held."""
    low = F.lower(prose)

    def held(beat: Column) -> Column:
        words = F.transform(S.words_of(F.lower(beat)), lambda w: w)
        return F.size(F.filter(words, lambda w: low.contains(w))) * 2 >= F.size(words)

    return F.when(F.size(beats) == 0, 1.0).otherwise(F.size(F.filter(beats, held)) / F.size(beats))


def grade_reason(prose: Column, target: Column, beats: Column | None = None) -> Column:
    """too_short, too_long, meta, grade_mismatch, dialogue_lost or null."""
    words = word_count(prose)
    rules = [
        (words < 30, F.lit("too_short")),
        (words > 400, F.lit("too_long")),
        (S.has_any(F.lower(prose), S.META), F.lit("meta_commentary")),
        (F.abs(S.reading_grade(prose) - target) > 1.5, F.lit("grade_mismatch")),
    ]
    if beats is not None:
        rules.append((preserved(beats, prose) < 0.8, F.lit("dialogue_lost")))
    return S.ordered(rules, F.lit(None).cast("string"))


def word_reason(prose: Column, word: Column, forms: Column | None = None) -> Column:
    """Rules of a short text that uses and defines one word, in any of its forms (by default only as it is)."""
    words, low, forms = word_count(prose), F.lower(prose), F.array(word) if forms is None else forms
    return S.ordered(
        [
            (words < 40, F.lit("too_short")), (words > 150, F.lit("too_long")), (~F.arrays_overlap(T.tokens(prose), forms), F.lit("word_missing")),
            (~T.word_defined(prose, word, forms), F.lit("no_definition")), (S.reading_grade(prose) > 8, F.lit("grade_too_high")), (S.has_any(low, S.META[:6]), F.lit("meta_commentary")),
        ],
        F.lit(None).cast("string"),
    )


def prefix_distinct(rows: DataFrame, text: str, order: str, n: int = 100) -> DataFrame:
    """Of rows whose texts begin with the same ``n`` characters the first."""
    w = Window.partitionBy(F.substring(text, 1, n)).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def supported(rows: DataFrame, content: str, order: str) -> DataFrame:
    """(hash, first, support_count): equal contents as one, with the first and their number."""
    return rows.groupBy(F.substring(F.sha2(F.col(content), 256), 1, 16).alias("hash")).agg(F.min(order).alias("first"), F.count("*").alias("support_count"))


def flattened(beats: Column) -> Column:
    """Beats as quoted lines."""
    return F.array_join(F.transform(beats, lambda b: F.concat(F.lit('"'), S.clean_text(b), F.lit('"'))), "\n")


def domain_report(rows: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """(field, value, n): values outside a field's domain, a missing one as null."""
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in domains)))
    table = F.create_map(*(x for c, values in domains.items() for x in (F.lit(c), F.array(*map(F.lit, values)))))
    return rows.select(fields.alias("f")).select("f.*").where(F.col("value").isNull() | ~F.array_contains(table[F.col("field")], F.col("value"))).groupBy("field", "value").agg(F.count("*").alias("n"))

"""Mixing sources to target weights: a Pfair schedule of source blocks, earliest deadline first.

A source with weight w of W in all owes its k-th block (k from 0) not before slot floor(k * W / w),
the release, and before slot ceil((k + 1) * W / w), the deadline. At each slot the released block
with the earliest deadline goes out. One slot holds one block, so that every deadline is met and
after t slots a source has had less than one block more or less than t * w / W. The schedule repeats
after W slots; only one period is drawn up, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents

#: Weights of a mix without given weights add up to about SHARES; rows in a block; rows in a cell of the order, about.
SHARES, BLOCK, CELL = 1000, 16, 4096
#: Given weights may add up to this, as a period has a slot for each; slots that are walked in one go.
LONGEST, STRETCH = 1_000_000, 500


def source_key(source: str = "source") -> Column:
    """A null source is a source of its own."""
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source)))


def shares_of(sizes: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """(src, n, q): the weight of each source of (src, n).

    Given weights are taken as they are; a source without one has 1. Without weights the targets are
    shares of SHARES in proportion to the square root of a source's size, one at least.
    """
    if weights:
        if any(int(w) != w or w < 1 for w in weights.values()) or sum(weights.values()) > LONGEST:
            raise ValueError(f"weights are whole numbers from 1 on that add up to {LONGEST} at most")
        table = F.create_map(*(x for s, w in weights.items() for x in (F.lit(f"={s}"), F.lit(int(w)))))
        return sizes.select("src", "n", F.coalesce(F.element_at(table, F.col("src")), F.lit(1)).cast("long").alias("q"))
    weighted = sizes.withColumn("w", F.floor(F.sqrt("n")).cast("long"))
    total = weighted.agg(F.sum("w").alias("all"))
    q = F.greatest(F.lit(1), F.expr(f"({SHARES} * w + all div 2) div all"))
    return weighted.join(F.broadcast(total)).select("src", "n", q.cast("long").alias("q"))


def schedule(shares: DataFrame) -> DataFrame:
    """(src, j, pos, q, period): the slot of each source's j-th block in a period.

    Sources are as few as a table of weights has them; one row holds them all, and SQL's own
    aggregate() walks the slots, a stretch at a time.
    """
    one = shares.agg(F.array_sort(F.collect_list(F.struct("src", "q"))).alias("s")).where("size(s) > 0")
    one = one.selectExpr("s", "transform(s, x -> x.q) AS q", "aggregate(s, 0L, (a, x) -> a + x.q) AS period")
    key = "CASE WHEN st.done[i] < q[i] AND (st.done[i] * period) div q[i] <= t THEN ((st.done[i] + 1) * period + q[i] - 1) div q[i] * 1000000 + i END"
    pick = f"array_min(transform(sequence(0, size(q) - 1), i -> {key}))"
    add = "named_struct('done', transform(s1.done, (x, i) -> IF(i = p, x + 1, x)), 'picks', concat(s1.picks, array(p)))"
    step = f"aggregate(array({pick} % 1000000), st, (s1, p) -> {add})"
    none = "CAST(array() AS array<bigint>)"
    slots = f"sequence(at * {STRETCH}, least(period, (at + 1) * {STRETCH}) - 1)"
    stretch = f"aggregate({slots}, named_struct('done', far.done, 'picks', {none}), (st, t) -> {step})"
    walk = f"aggregate(array({stretch}), far, (f1, x) -> named_struct('done', x.done, 'lots', concat(f1.lots, array(x.picks))))"
    start = "named_struct('done', transform(q, x -> 0L), 'lots', CAST(array() AS array<array<bigint>>))"
    walked = one.selectExpr("s", "period", f"flatten(aggregate(sequence(0L, (period - 1) div {STRETCH}), {start}, (far, at) -> {walk}).lots) AS picks")
    slots = walked.selectExpr("s", "period", "posexplode(picks) AS (pos, i)").selectExpr("s[i].src AS src", "s[i].q AS q", "period", "CAST(pos AS long) AS pos")
    return slots.withColumn("j", F.row_number().over(Window.partitionBy("src").orderBy("pos")).cast("long") - 1)


def pfair_mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """docs with mix_block, mix_slot, mix_place and mix_balanced; in order of (mix_slot, mix_place) they are the mix.

    A source's rows stand in the order of a hash of doc_id and text and are cut into blocks of
    ``block`` rows. mix_balanced is true up to the slot at which the first source has no whole block
    left: so far each source has had its target within less than one block. Later the others go on
    in their own slots; no row is left out.

    Weights are whole numbers by source, see ``shares_of``. A null source is a source; so are null
    ids and texts values like others. Rows with equal doc_id and text are alike and stand in any
    order. Empty tables give empty results. Other columns stay as they are, whatever their names;
    columns of the four names above are replaced.
    """
    names = ["mix_block", "mix_slot", "mix_place", "mix_balanced"]
    rows = docs.drop(*names)
    # the row's own columns are put away together, so that no work column can meet one of them
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    value = F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("row.text", F.lit(""))))
    sizes = docs.select(source_key().alias("src")).groupBy("src").agg(F.count("*").alias("n"))
    cells = sizes.agg(F.expr(f"greatest(1L, sum(n) div {CELL})").alias("cells"))
    keyed = rows.select("row", source_key("row.source").alias("src"), F.sha2(value, 256).alias("hash")).join(F.broadcast(cells))
    keyed = keyed.withColumn("cell", F.expr("CAST(conv(substr(hash, 1, 8), 16, 10) AS bigint) * cells div 4294967296")).drop("cells")
    shares = shares_of(sizes, weights)
    plan = schedule(shares)
    # the first slot of a source that has no whole block for it
    short = shares.select("src", F.expr(f"n div {block}").alias("k"))
    ends = plan.join(short, "src").where("j = k % q").agg(F.min(F.expr("k div q * period + pos")).alias("end"))
    before = keyed.groupBy("src", "cell").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("src", "cell", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("src", "cell").orderBy("hash", "row.doc_id", "row.text"))
    ranked = keyed.withColumn("rn", place).join(before, ["src", "cell"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    ranked = ranked.select("row", "src", F.expr(f"rank div {block}").alias("mix_block"), F.expr(f"rank % {block}").alias("mix_place"))
    # a period has at most LONGEST slots, a source a row: bounded whatever the input
    q = F.broadcast(shares.select(F.col("src").alias("q_src"), F.col("q").alias("own_q")))
    out = ranked.join(q, F.col("src") == F.col("q_src")).withColumn("own_j", F.expr("mix_block % own_q"))
    out = out.join(F.broadcast(plan.select(F.col("src").alias("p_src"), "j", "pos", "period")), (F.col("src") == F.col("p_src")) & (F.col("own_j") == F.col("j")))
    out = out.withColumn("mix_slot", F.expr("mix_block div own_q * period + pos")).join(F.broadcast(ends))
    return out.select("row.*", "mix_block", "mix_slot", "mix_place", (F.col("mix_slot") < F.col("end")).alias("mix_balanced"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return pfair_mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_place", "mix_balanced")


QUERIES = {"op4_pfair_mixing": op4_pfair_mixing}
SQL = {
    "op4_pfair_mixing": f"""
WITH RECURSIVE keyed AS (
  SELECT *, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS src,
         sha256(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, text NULLS FIRST) - 1 AS rank FROM keyed
), weighted AS (
  SELECT src, count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM keyed GROUP BY src
), shares AS (
  SELECT src, n, greatest(1, CAST(({SHARES} * w + (SELECT sum(w) FROM weighted) // 2) // (SELECT sum(w) FROM weighted) AS BIGINT)) AS q,
         row_number() OVER (ORDER BY src) AS i FROM weighted
), lists AS (
  SELECT list(q ORDER BY i) AS qs, CAST(sum(q) AS BIGINT) AS period FROM shares
), walk AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS done, qs, period FROM lists
  UNION ALL
  SELECT t + 1, next_pick, list_transform(range(1, len(qs) + 1), lambda k: done[k] + CASE WHEN k = next_pick THEN 1 ELSE 0 END), qs, period
  FROM (SELECT *, list_min(list_transform(range(1, len(qs) + 1), lambda k:
          CASE WHEN done[k] < qs[k] AND (done[k] * period) // qs[k] <= t + 1
               THEN ((done[k] + 1) * period + qs[k] - 1) // qs[k] * 1000000 + k END)) % 1000000 AS next_pick
        FROM walk WHERE t + 1 < period)
), plan AS (
  SELECT src, q, period, t AS pos, row_number() OVER (PARTITION BY src ORDER BY t) - 1 AS j, n
  FROM walk JOIN shares ON pick = i WHERE t >= 0
), ends AS (
  SELECT min((n // {BLOCK}) // q * period + pos) AS stop FROM plan WHERE j = (n // {BLOCK}) % q
)
SELECT doc_id, source, rank // {BLOCK} AS mix_block, (rank // {BLOCK}) // q * period + pos AS mix_slot, rank % {BLOCK} AS mix_place,
       (rank // {BLOCK}) // q * period + pos < (SELECT stop FROM ends) AS mix_balanced
FROM ranked JOIN plan ON ranked.src = plan.src AND (rank // {BLOCK}) % q = j
"""
}

"""Preference formatting: pairs of chosen and rejected conversations become training examples.

The longest common prefix of turns (role and text alike, null equal to null) is rendered once as
the prompt; what follows on either side becomes a completion with its loss mask, the spans of the
assistant's texts in it.

A conversation is one example and so has to fit into a row; that is the only thing gathered, by
pair, and pairs are keyed by conversation, so a turn or a conversation that recurs makes no hot
key. Turns are ordered by turn, then role, then text, so repeated rows and ties have one order.
Null texts render as empty, null roles as an empty role. A conversation without a partner has an
empty other side and an empty prompt. Turns with a null conv_id belong to no conversation and are
left out; extra columns change nothing; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trawl.llm.shared import pick, table

TRAINED_ROLE = "assistant"


def _turns(side: str) -> Column:
    return F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", "text")))),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
    )


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.coalesce(turn["text"], F.lit(""))


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("<|end|>\n"))))


def masks(turns: Column) -> Column:
    """start:end of each trained text with its end mark, in code points of the rendered turns."""

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.char_length(_head(t))
        end = start + F.char_length(_body(t)) + len("<|end|>")
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.concat_ws(",", F.aggregate(turns, zero, step, lambda a: a["spans"]))


def formatted(sides: DataFrame) -> DataFrame:
    """sides: pair_id, c and r, the turns (role, text) of the chosen and of the rejected. Per pair: prompt, completions, masks, counts."""
    least = F.least(F.size("c"), F.size("r"))
    differ = F.array_position(F.zip_with(F.slice("c", 1, least), F.slice("r", 1, least), lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    known = sides.withColumn("n", F.when(differ > 0, differ - 1).otherwise(least))
    rest = {k: F.slice(k, F.col("n") + 1, F.greatest(F.size(k) - F.col("n"), F.lit(0))) for k in "cr"}
    return known.select(
        "pair_id",
        F.col("n").cast("long").alias("prompt_turns"),
        F.size("c").cast("long").alias("chosen_turns"),
        F.size("r").cast("long").alias("rejected_turns"),
        rendered(F.slice("c", 1, F.col("n"))).alias("prompt"),
        rendered(rest["c"]).alias("chosen"),
        rendered(rest["r"]).alias("rejected"),
        masks(rest["c"]).alias("chosen_mask"),
        masks(rest["r"]).alias("rejected_mask"),
    )


def _sides(turns: DataFrame) -> DataFrame:
    return pick(turns, "pair_id", "side", "turn", "role", "text").groupBy("pair_id").agg(_turns("chosen").alias("c"), _turns("rejected").alias("r"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text. Per pair: prompt, completions, masks, counts."""
    return formatted(_sides(turns))


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair k: chosen is conversation 2k; rejected has its first k mod n of n turns, and goes on as conversation 2k + 1 does from there.

    The table holds single conversations; so made, pairs fork where two answers to one prompt would.
    """
    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    both = _sides(turns.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), side.alias("side"), "turn", "role", "text"))
    fork = F.pmod("pair_id", F.greatest(F.size("c"), F.lit(1))).cast("int")
    forked = F.concat(F.slice("c", 1, F.col("fork")), F.slice("r", F.col("fork") + 1, F.greatest(F.size("r") - F.col("fork"), F.lit(0))))
    return formatted(both.withColumn("fork", fork).select("pair_id", "c", forked.alias("r")))


def oracle_sql() -> str:
    shown = "'<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10)"
    return f"""
WITH every AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, ((conv_id % 2) + 2) % 2 AS side, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
forks AS (SELECT pair_id, CASE WHEN nc = 0 THEN 0 ELSE ((pair_id % nc) + nc) % nc END AS fork FROM (SELECT pair_id, count(*) FILTER (side = 0) AS nc FROM every GROUP BY 1)),
t AS (
  SELECT *, {shown} AS shown, length('<|' || coalesce(role, '') || '|>') + 1 AS head FROM (
    SELECT pair_id, 0 AS side, i, role, text FROM every WHERE side = 0
    UNION ALL SELECT pair_id, 1, i, role, text FROM every JOIN forks USING (pair_id) WHERE side = 0 AND i <= fork
    UNION ALL SELECT pair_id, 1, i, role, text FROM every JOIN forks USING (pair_id) WHERE side = 1 AND i > fork)),
sizes AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY 1),
alike AS (
  SELECT s.pair_id, coalesce(min(c.i) FILTER (c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) - 1, least(any_value(nc), any_value(nr))) AS n
  FROM sizes s LEFT JOIN t c ON c.pair_id = s.pair_id AND c.side = 0 LEFT JOIN t r ON r.pair_id = s.pair_id AND r.side = 1 AND r.i = c.i
  WHERE c.i IS NULL OR c.i <= least(nc, nr) GROUP BY 1),
p AS (SELECT t.*, n, coalesce(sum(length(shown)) FILTER (i > n) OVER (PARTITION BY t.pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM t JOIN alike USING (pair_id)),
m AS (SELECT *, (before + head)::VARCHAR || ':' || (before + length(shown) - 1)::VARCHAR AS span FROM p)
SELECT s.pair_id, CAST(any_value(n) AS BIGINT) AS prompt_turns, CAST(any_value(nc) AS BIGINT) AS chosen_turns, CAST(any_value(nr) AS BIGINT) AS rejected_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 0 AND i > n AND role = '{TRAINED_ROLE}'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 1 AND i > n AND role = '{TRAINED_ROLE}'), '') AS rejected_mask
FROM m JOIN sizes s USING (pair_id) GROUP BY 1"""

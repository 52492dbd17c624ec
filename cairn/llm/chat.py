"""Chat formatting (3), DataFrame functions only: every participant's view of a dialogue.

For each participant of a conversation the turns are rendered with that speaker as the assistant and the others as
named users; turns of the role ``system`` stay system turns and have no view of their own. The mask lists
the code points to learn from: the speaker's texts with their end marks, as start:end joined by commas, counted from the dialogue's start.

A dialogue of up to ``LONGEST`` turns is one row, whatever its turn numbers. A longer one is one text in several rows, so that no
row or task holds an unbounded dialogue: ``part`` numbers them, each begins ``start`` code points into the
text, and joined in order they are the whole. Turns are in order of turn, role and text. Null text counts as empty, a null role as
``unknown``, a null turn as one before all others, a null conversation id as an id of its
own. Rows that repeat are turns each. A conversation of system turns alone has no views; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LONGEST = 512
START, END = "<|im_start|>", "<|im_end|>\n"


def _numbered(turns: DataFrame, longest: int) -> DataFrame:
    """The turns of long dialogues with ``part``, numbered without sorting a dialogue in one task; a kept table."""
    order = ["conv_id", "turn", "role", "text"]
    # ranges of the whole order; a turn's place is its place in its range behind what the ranges before hold of its dialogue
    dealt = turns.select(*order).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = common.keep(dealt.withColumn("place", F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order))), "chat-turns")
    sizes = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("conv_id").alias("of"), F.col("range").alias("r"), _before("n", "range", "conv_id").alias("before"))
    placed = dealt.join(sizes, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("r")))
    out = common.keep(placed.select(*order, F.floor((F.col("before") + F.col("place") - 1) / longest).cast("long").alias("part")), "chat-parts")
    common.drop(dealt)
    return out


def _before(n: str, order: str, *by: str) -> Column:
    return F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _starts(placed: DataFrame, speakers: DataFrame) -> DataFrame:
    """Where each part of a long dialogue starts for each participant: all turns before, as users', less what the participant's own heads are shorter."""
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    head = F.when(F.col("role") == "system", len("system")).otherwise(F.length("role") + len("user name="))
    roles = placed.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("text") + head + len(START) + len("\n") + len(END)).alias("size"))
    parts = roles.groupBy("conv_id", "part").agg(F.sum("size").alias("size")).withColumn("all", _before("size", "part", "conv_id"))
    grid = parts.join(speakers, same).select("conv_id", "part", "participant", "all")
    own = roles.select(F.col("conv_id").alias("of"), F.col("part").alias("p"), "role", "n")
    grid = grid.join(own, same & (F.col("part") == F.col("p")) & (F.col("participant") == F.col("role")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shorter = F.length("participant") + len("user name=") - len("assistant")
    return grid.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("participant").alias("who"), (F.col("all") - shorter * _before("n", "part", "conv_id", "participant")).cast("long").alias("start"))


def views(turns: DataFrame, longest: int = LONGEST) -> DataFrame:
    """conv_id, participant, part, start, n_turns, rendered, mask."""
    turns = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    speakers = turns.where("role <> 'system'").select(F.col("conv_id").alias("of"), F.col("role").alias("participant")).distinct()
    many = common.keep(turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > longest).select(F.col("conv_id").alias("of")), "chat-long")

    def gathered(t: DataFrame) -> DataFrame:
        return t.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).join(speakers, same).drop("of")

    both = gathered(turns.join(many, same, "left_anti").withColumn("part", F.lit(0).cast("long"))).withColumn("start", F.lit(0).cast("long"))
    if not many.isEmpty():
        placed = _numbered(turns.join(many, same, "left_semi"), longest)
        at = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("participant") == F.col("who"))
        both = both.unionByName(gathered(placed).join(_starts(placed, speakers), at).drop("c", "p", "who"))

    def line(t):
        head = F.when(t["role"] == "system", "system").when(t["role"] == F.col("participant"), "assistant").otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.struct((t["role"] == F.col("participant")).alias("own"), F.concat(F.lit(START), head, F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"))

    lines = both.withColumn("lines", F.transform("turns", line))
    place = F.aggregate(
        "lines",
        F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
            F.when(t["own"], F.array_append(a["spans"], F.concat_ws(":", a["at"] + F.length(t["head"]), a["at"] + F.length(t["head"]) + F.length(t["body"])))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    rendered = F.array_join(F.transform("lines", lambda t: F.concat(t["head"], t["body"])), "")
    return lines.select("conv_id", "participant", "part", "start", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), F.array_join(place["spans"], ",").alias("mask"))


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS participant FROM turns WHERE role <> 'system'),
lines AS (
  SELECT t.*, participant, role = participant AS own, (i - 1) // 512 AS part,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = participant THEN 'assistant'
                                ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER w - length(body) AS from_, sum(length(head) + length(body)) OVER w AS to_
  FROM lines WINDOW w AS (PARTITION BY conv_id, participant ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, part, CAST(min(from_ - length(head)) AS BIGINT) AS start, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY i) AS rendered,
       coalesce(string_agg(CAST(from_ AS BIGINT) || ':' || CAST(to_ AS BIGINT), ',' ORDER BY i) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, participant, part
"""

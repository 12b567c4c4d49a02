"""Preference formatting: chosen and rejected conversations become one prompt and two masked completions.

The longest common turn prefix of the two conversations is rendered once; what follows in each is its completion, with
the character spans of assistant texts as the loss mask. Everything is a DataFrame expression; there is no Python code
on the executors. Pairs are formed among conversations with the same opening turn, by rank within the opening; the rank
is a local rank in one of 64 slices plus the slice's offset, so an opening shared by any number of conversations is never
ordered in one task.

Defined cases: null roles and texts are empty; rows repeated exactly count once; turns are ordered by turn (null first),
role, text; rows of a null conv_id make one conversation; if one conversation is a prefix of the other, its completion is
empty; a conversation left without a partner has null rejected columns and its last turn as completion; markers inside
texts are broken up by a space; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES = 64
OPEN, SHUT, END = "<|", "|>", "<|end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, an ordered array of struct turn, role, text."""
    clean = lambda c: F.coalesce(F.replace(F.col(c), F.lit(OPEN), F.lit("< |")), F.lit(""))
    turn = F.struct("turn", clean("role").alias("role"), clean("text").alias("text"))
    return turns.select("conv_id", turn.alias("item")).groupBy("conv_id").agg(F.array_sort(F.collect_set("item")).alias("turns"))


def pair_by_opening(talks: DataFrame) -> DataFrame:
    """chosen_id, chosen, rejected_id and rejected: neighbours in the ranking of conversations that open alike."""
    first = F.col("turns")[0]
    ranked = talks.select("conv_id", "turns", F.md5(F.concat(first["role"], F.lit("\x1f"), first["text"])).alias("opening"), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(SLICES)).alias("slice"))
    offsets = ranked.groupBy("opening", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("opening").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("opening", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = Window.partitionBy("opening", "slice").orderBy(F.col("conv_id").asc_nulls_first())
    ranked = ranked.withColumn("local", F.row_number().over(local) - 1).join(offsets, ["opening", "slice"]).withColumn("rank", F.col("offset") + F.col("local"))
    side = lambda k: F.max(F.when(F.pmod("rank", F.lit(2)) == k, F.struct("conv_id", "turns")))
    pairs = ranked.groupBy("opening", F.floor(F.col("rank") / 2).alias("pair")).agg(side(0).alias("a"), side(1).alias("b"))
    return pairs.select(F.col("a.conv_id").alias("chosen_id"), F.col("a.turns").alias("chosen"), F.col("b.conv_id").alias("rejected_id"), F.col("b.turns").alias("rejected"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SHUT + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(f"\n{END}\n"))), "")


def mask(turns: Column) -> Column:
    """Character spans of assistant texts in the rendering of ``turns``."""
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(_head(t)) + F.length(t["text"]) + len(END) + 2).alias("at"),
        F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(_head(t))).alias("lo"), (acc["at"] + F.length(_head(t)) + F.length(t["text"])).alias("hi"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<lo:int,hi:int>>)").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """prompt, n_prompt_turns, and text and mask of both completions of each pair of turn arrays."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", 1, shorter), F.slice("rejected", 1, shorter), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    stop = F.array_position(same, False)
    prefix = F.when(F.col("rejected").isNull(), F.size("chosen") - 1).when(stop == 0, shorter).otherwise((stop - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    cut = pairs.withColumn("n_prompt_turns", prefix)
    return cut.select(
        "chosen_id", "rejected_id", "n_prompt_turns", rendered(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen"), mask(rest("chosen")).alias("chosen_mask"),
        F.when(F.col("rejected").isNotNull(), rendered(rest("rejected"))).alias("rejected"), F.when(F.col("rejected").isNotNull(), mask(rest("rejected"))).alias("rejected_mask"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    return format_pairs(pair_by_opening(conversations(turns)))


def spans_text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["lo"].cast("string"), s["hi"].cast("string"))), ";")


def preference_sql() -> str:
    """The same for DuckDB, masks written as lo-hi;lo-hi."""
    side = lambda name: f"""
{name}_t AS (SELECT p.chosen_id, s.i, s.role, s.text, '<|' || s.role || '|>' || chr(10) AS head, '<|' || s.role || '|>' || chr(10) || s.text || chr(10) || '<|end|>' || chr(10) AS piece, p.prefix
      FROM q p JOIN s ON s.conv_id = p.{name}_id),
{name}_w AS (SELECT *, CAST(coalesce(sum(CASE WHEN i > prefix THEN length(piece) END) OVER (PARTITION BY chosen_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS lo FROM {name}_t),
{name}_g AS (SELECT chosen_id, coalesce(string_agg(piece, '' ORDER BY i) FILTER (i <= prefix), '') AS prompt, coalesce(string_agg(piece, '' ORDER BY i) FILTER (i > prefix), '') AS body,
      coalesce(string_agg(lo || '-' || (lo + length(text)), ';' ORDER BY i) FILTER (i > prefix AND role = 'assistant'), '') AS spans FROM {name}_w GROUP BY chosen_id)"""  # noqa: E731
    return f"""
WITH d AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
o AS (SELECT conv_id, n, md5(role || chr(31) || text) AS opening FROM s WHERE i = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY conv_id % {SLICES}, conv_id) - 1 AS k FROM o),
p AS (SELECT a.conv_id AS chosen_id, a.n AS cn, b.conv_id AS rejected_id, b.n AS rn FROM r a LEFT JOIN r b ON a.opening = b.opening AND b.k = a.k + 1 WHERE a.k % 2 = 0),
f AS (SELECT p.chosen_id, min(x.i) AS stop FROM p JOIN s x ON x.conv_id = p.chosen_id JOIN s y ON y.conv_id = p.rejected_id AND y.i = x.i WHERE x.role <> y.role OR x.text <> y.text GROUP BY p.chosen_id),
q AS (SELECT p.chosen_id, p.rejected_id, CAST(CASE WHEN p.rejected_id IS NULL THEN cn - 1 ELSE coalesce(f.stop - 1, least(cn, rn)) END AS INTEGER) AS prefix FROM p LEFT JOIN f ON p.chosen_id = f.chosen_id),
{side("chosen")},{side("rejected")}
SELECT q.chosen_id, q.rejected_id, q.prefix AS n_prompt_turns, c.prompt, c.body AS chosen, c.spans AS chosen_mask, e.body AS rejected, e.spans AS rejected_mask
FROM q JOIN chosen_g c ON q.chosen_id = c.chosen_id LEFT JOIN rejected_g e ON q.chosen_id = e.chosen_id"""

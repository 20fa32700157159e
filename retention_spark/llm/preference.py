"""Preference formatting of chat conversations, with DataFrame functions only.

A pair is two versions of a conversation, one chosen, one rejected. The longest prefix of turns that
both share is rendered once, as the prompt; what follows is rendered as two completions, with
the characters that a loss should cover: what assistants say, and the mark that ends it.

The first turn at which the versions differ is a minimum, which combines before the shuffle. Where a completion's
turns begin is a running sum over blocks of BLOCK turns, first within each block and then
over the blocks, so the turns of a long pair are sorted in many tasks. Only the last step, whose
result is one row a pair, brings a pair's text together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns that one running sum goes over.
BLOCK = 1024
ASSISTANT = "assistant"
END = "<|end|>\n"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _plain(text: Column) -> Column:
    """Marks inside a text are broken up, so that they stay text."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def formatted_pairs(turns: DataFrame) -> DataFrame:
    """`turns` (pair_id, chosen: boolean, turn, role, text) as one row per pair: pair_id,
    prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss; the last two list begin:end
    of the characters (code points) of the completion to learn from.

    Turns are ordered by number, null last. Rows that repeat are one turn; different ones with one number are
    ordered by role, then text. Null role or text is empty; rows without pair_id or side belong to
    no conversation. Versions without a difference give two empty completions; a missing version is an
    empty one. An empty table gives no rows; other columns are not looked at.
    """
    rows = turns.filter("pair_id is not null and chosen is not null").select(
        "pair_id", "chosen", F.col("turn").cast("bigint").alias("turn"),
        _plain(F.col("role")).alias("role"), _plain(F.col("text")).alias("text")).distinct()
    place = F.coalesce("turn", F.lit(2**63 - 1))
    said = F.struct("role", "text")
    versions = rows.groupBy("pair_id", place.alias("place")).agg(
        F.sort_array(F.collect_set(F.when(F.col("chosen"), said))).alias("a"),
        F.sort_array(F.collect_set(F.when(~F.col("chosen"), said))).alias("b"))
    parting = versions.groupBy("pair_id").agg(
        F.min(F.when(F.col("a") != F.col("b"), F.col("place"))).alias("parting"),
        F.count_if(F.col("a") == F.col("b")).alias("same"))
    placed = rows.withColumn("place", place).join(parting, "pair_id")
    shared = F.col("parting").isNull() | (F.col("place") < F.col("parting"))
    part = F.when(shared, "prompt").when(F.col("chosen"), "chosen").otherwise("rejected")
    piece = F.concat(_header(F.col("role")), F.col("text"), F.lit(END))
    # Null turns are the last block.
    block = F.when(F.col("turn").isNull(), F.lit(2**62)).otherwise(F.floor(F.col("turn") / BLOCK))
    pieces = placed.filter(F.col("chosen") | ~shared).select(
        "pair_id", block.cast("bigint").alias("block"), "parting", "place", "role", "text",
        part.alias("part"), piece.alias("piece"))
    inside = Window.partitionBy("pair_id", "part", "block").orderBy("place", "role", "text")
    within = pieces.withColumn("within", F.sum(F.length("piece")).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    of_block = pieces.groupBy("pair_id", "part", "block").agg(
        F.sum(F.length("piece")).alias("size"))
    earlier = Window.partitionBy("pair_id", "part").orderBy("block")
    offsets = of_block.select("pair_id", "part", "block", F.coalesce(F.sum("size").over(
        earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ends = within.join(offsets, ["pair_id", "part", "block"]).withColumn(
        "until", F.col("within") + F.col("offset"))
    begin = F.col("until") - F.length("text") - len(END)
    learned = F.when(F.col("role") == ASSISTANT, F.concat_ws(":", begin, F.col("until")))
    ready = ends.withColumn("learned", learned)

    def of(name: str, field: str, mark: str) -> Column:
        mine = F.when(F.col("part") == name, F.struct("place", "role", "text", field))
        return F.array_join(F.transform(F.sort_array(F.collect_list(mine)),
                                        lambda x: x[field]), mark)

    return ready.groupBy("pair_id").agg(
        F.count_if(F.col("part") == "prompt").alias("prompt_turns"),
        of("prompt", "piece", "").alias("prompt"), of("chosen", "piece", "").alias("chosen"),
        of("rejected", "piece", "").alias("rejected"),
        of("chosen", "learned", ",").alias("chosen_loss"),
        of("rejected", "learned", ",").alias("rejected_loss"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from conversations (conv_id, turn, role, text): each as it is, chosen, against itself with the
    last thing the assistant says replaced by that of conversation conv_id + 1 (nothing, where there is
    none). A conversation in which no assistant speaks gives equal versions."""
    spoken = conversations.filter((F.col("role") == ASSISTANT) & F.col("conv_id").isNotNull())
    last = spoken.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"),
                        F.coalesce("last.text", F.lit("")).alias("reply"))
    swaps = last.select("conv_id", F.col("last.turn").alias("last_turn")).join(
        other, "conv_id", "left").select("conv_id", "last_turn", F.lit(True).alias("speaks"), F.coalesce(
            "reply", F.lit("")).alias("reply"))
    rows = conversations.select("conv_id", "turn", "role", "text").join(swaps, "conv_id", "left")
    swapped = F.coalesce(F.col("speaks"), F.lit(False)) & (F.col("role") == ASSISTANT) & F.col(
        "turn").eqNullSafe(F.col("last_turn"))
    both = F.explode(F.array(F.lit(True), F.lit(False)))
    return rows.withColumn("chosen", both).select(
        F.col("conv_id").alias("pair_id"), "chosen", "turn", "role",
        F.when(swapped & ~F.col("chosen"), F.col("reply")).otherwise(F.col("text")).alias("text"))


ORACLE_SQL = """
with spoken as (select * from conversations where role = 'assistant' and conv_id is not null),
last as (select conv_id, max(turn) as last_turn from spoken group by conv_id),
replies as (select s.conv_id, last_turn, max(coalesce(text, '')) as reply
            from spoken s join last l on s.conv_id = l.conv_id and s.turn = l.last_turn
            group by s.conv_id, last_turn),
swaps as (select a.conv_id, a.last_turn, coalesce(b.reply, '') as reply
          from replies a left join replies b on b.conv_id = a.conv_id + 1),
sides as (
  select c.conv_id as pair_id, side, cast(turn as bigint) as turn,
    replace(coalesce(role, ''), '<|', '< |') as role,
    replace(coalesce(case when not side and role = 'assistant' and turn = last_turn then reply
                          else text end, ''), '<|', '< |') as text
  from conversations c left join swaps s on s.conv_id = c.conv_id,
    (select unnest([true, false]) as side) where c.conv_id is not null),
rows as (select distinct * from sides),
unmatched as (
  select pair_id, turn from rows group by pair_id, turn, role, text having count(*) = 1),
parting as (select p.pair_id, min(u.turn) as parting
            from (select distinct pair_id from rows) p left join unmatched u using (pair_id)
            group by p.pair_id),
pieces as (
  select r.pair_id, turn, role, text,
    case when parting is null or turn < parting then 'prompt'
         when side then 'chosen' else 'rejected' end as part,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as piece
  from rows r join parting using (pair_id) where side or turn >= parting),
ends as (select *, sum(length(piece)) over (partition by pair_id, part
                                            order by turn, role, text) as until from pieces),
ready as (select *, case when role = 'assistant'
    then (until - length(text) - 8)::bigint || ':' || until::bigint end as learned from ends)
select pair_id, count(*) filter (part = 'prompt') as prompt_turns,
  coalesce(string_agg(piece, '' order by turn, role, text) filter (part = 'prompt'), '') as prompt,
  coalesce(string_agg(piece, '' order by turn, role, text) filter (part = 'chosen'), '') as chosen,
  coalesce(string_agg(piece, '' order by turn, role, text) filter (part = 'rejected'), '') as rejected,
  coalesce(string_agg(learned, ',' order by turn, role, text) filter (part = 'chosen'), '')
    as chosen_loss,
  coalesce(string_agg(learned, ',' order by turn, role, text) filter (part = 'rejected'), '')
    as rejected_loss
from ready group by pair_id"""

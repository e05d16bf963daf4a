"""Preference formatting: one prompt, and two masked completions, of a chosen and a rejected conversation.

The turns of both conversations are aligned by position. The longest common turn prefix is rendered once, as the prompt;
what follows in either is its completion. A mask lists the spans of a completion that are trained on: the texts of the
assistant's turns with their end marks. Everything is DataFrame functions; a pair becomes one row, which holds its two
conversations, and no more than that meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.scratch import Scratch

END = "<|end|>\n"
TRAINED = "assistant"
RESULTS = ("prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    """The turns of an array (role, text) as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def spans(turns: Column) -> Column:
    """The spans [from, to) in characters of render(turns) that are trained on."""
    none = F.array().cast("array<struct<from: int, to: int>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        own = F.array(F.struct(start.alias("from"), end.alias("to")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading elements in which two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    # a missing element is null and differs from any turn
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def conversations(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): the turns of each conversation in order. Null roles are ``unknown``, null texts are empty."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select("key", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (key, chosen, rejected: arrays of (role, text)) as prompt, completions and masks.

    A missing conversation is an empty one. A null role is rendered as ``unknown``, a null text as an empty one, and a
    null turn as both; they are compared as they are rendered. Equal conversations are all prompt and have empty
    completions; conversations that differ from the first turn on have an empty prompt. Turns of any length are kept
    whole. Repeated pairs give repeated rows, an empty table none. Other columns are kept, but for those that have the
    name of a result.
    """
    none = F.array().cast("array<struct<role: string, text: string>>")
    plain = lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    sides = [F.transform(F.coalesce(c, none), plain).alias(c) for c in ("chosen", "rejected")]
    kept = [c for c in pairs.columns if c not in (*RESULTS, "n", "shared")]
    rows = pairs.select(*kept, *sides)
    rows = rows.withColumn("n", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    rows = rows.select(*kept, "n", F.slice("chosen", 1, F.col("n")).alias("shared"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return rows.select(
        *kept,
        F.col("n").alias("prompt_turns"),
        render(F.col("shared")).alias("prompt"),
        render(F.col("chosen")).alias("chosen"),
        spans(F.col("chosen")).alias("chosen_mask"),
        render(F.col("rejected")).alias("rejected"),
        spans(F.col("rejected")).alias("rejected_mask"),
    )


def pairs_of(turns: DataFrame) -> DataFrame:
    """Pairs (key, status, chosen, rejected) from plain conversations (conv_id, turn, role, text), one for each conversation.

    Conversations with an assistant's turn are numbered from 0 in the order of their ids, which may be of any type that
    has one. Number k turns off at its assistant's turn k mod their number, counted from 0: chosen is the whole
    conversation, rejected has its turns before that one and then the turns of the next conversation from where that
    turns off; after the last comes the first. Their status is ``pair``. A conversation without an assistant's turn has
    the status ``no reply``, and one that has no other to be paired with ``alone``; both are all prompt. Rows without a
    conversation id belong to no conversation and go.
    """
    rows = conversations(turns, "conv_id")
    scratch = Scratch(turns.sparkSession)
    at = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("replies", at)
    # dealt by ranges, in each of which those with a reply come first: a place in the range and the counts of the ranges
    # before number them, so no task sorts all conversations
    silent = F.size("replies") == 0
    parts = rows.repartitionByRange("key").sortWithinPartitions(silent, "key").withColumn("place", F.monotonically_increasing_id())
    parts = scratch.table(parts.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))))
    replied = parts.where(~silent)
    counts = {r["part"]: r["n"] for r in replied.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each range
    total, before = sum(counts.values()), []
    for p in sorted(counts):
        before += [F.lit(p), F.lit(sum(counts[q] for q in counts if q < p)).cast("long")]
    silent = parts.where(silent).select("key", F.lit("no reply").alias("status"), F.col("turns").alias("chosen"), F.col("turns").alias("rejected"))
    if total < 2:
        return silent.union(replied.select("key", F.lit("alone"), "turns", "turns"))
    numbered = replied.withColumn("k", F.col("place") + F.element_at(F.create_map(*before), F.col("part")))
    # the turn, from 1, at which a conversation turns off
    off = F.element_at("replies", (F.col("k") % F.size("replies") + 1).cast("int")) + 1
    numbered = numbered.select("key", "turns", "k", off.alias("off"))
    tails = numbered.select(F.pmod(F.col("k") - 1, F.lit(total)).alias("k"), F.slice("turns", F.col("off"), F.size("turns")).alias("tail"))
    paired = numbered.join(tails, "k").select(
        "key", F.lit("pair").alias("status"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("off") - 1), "tail").alias("rejected")
    )
    return silent.union(paired)


def mask_text(mask: Column) -> Column:
    """A mask as text, from:to joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat(s["from"].cast("string"), F.lit(":"), s["to"].cast("string"))), ",")


ORACLE_SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, role, text
  from (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), c as (
  select conv_id, count(*) as n, count(*) filter (where role = 'assistant') as replies from t group by conv_id
), k as (
  select conv_id, row_number() over (order by conv_id) - 1 as k, count(*) over () as total, replies from c where replies > 0
), a as (
  select conv_id, pos, row_number() over (partition by conv_id order by pos) - 1 as nth from t where role = 'assistant'
), o as (
  select k.conv_id, k.k, k.total, a.pos as cut from k join a on a.conv_id = k.conv_id and a.nth = k.k % k.replies
), partner as (
  select o.conv_id, o.cut, p.conv_id as other, p.cut as other_cut from o join o p on p.k = (o.k + 1) % o.total where o.total > 1
), chosen as (
  select conv_id, pos, role, text from t
), rejected as (
  select t.conv_id, t.pos, t.role, t.text from t left join partner p on p.conv_id = t.conv_id where p.conv_id is null or t.pos < p.cut
  union all
  select p.conv_id, p.cut + t.pos - p.other_cut, t.role, t.text from partner p join t on t.conv_id = p.other and t.pos >= p.other_cut
), same as (
  select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.pos, b.pos) as pos, a.role is not distinct from b.role and a.text is not distinct from b.text as same
  from chosen a full join rejected b on a.conv_id = b.conv_id and a.pos = b.pos
), prefix as (
  select conv_id, coalesce(min(pos) filter (where not same), max(pos) + 1) - 1 as k from same group by conv_id
), sides as (
  select 'c' as side, * from chosen union all select 'r' as side, * from rejected
), r as (
  select side, s.conv_id, pos, role, k, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body from sides s join prefix p on p.conv_id = s.conv_id
), m as (
  select *, coalesce(sum(case when pos > k then length(head) + length(body) else 0 end) over (partition by side, conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as start from r
), g as (
  select conv_id, side, max(k) as k,
    coalesce(string_agg(head || body, '' order by pos) filter (where pos <= k), '') as prompt,
    coalesce(string_agg(head || body, '' order by pos) filter (where pos > k), '') as completion,
    coalesce(string_agg((start + length(head)) || ':' || (start + length(head) + length(body)), ',' order by pos) filter (where pos > k and role = 'assistant'), '') as mask
  from m group by conv_id, side
)
select c.conv_id, case when c.replies = 0 then 'no reply' when p.conv_id is null then 'alone' else 'pair' end as status,
  cast(a.k as integer) as prompt_turns, a.prompt, a.completion as chosen, a.mask as chosen_mask, coalesce(b.completion, '') as rejected, coalesce(b.mask, '') as rejected_mask
from c join g a on a.conv_id = c.conv_id and a.side = 'c' left join g b on b.conv_id = c.conv_id and b.side = 'r' left join partner p on p.conv_id = c.conv_id
"""

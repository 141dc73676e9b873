"""Preference pairs for training: the shared prompt once, and two masked completions.

For each pair of conversations the longest common prefix of turns (same role, same text) is the
prompt. What follows in either is its completion, rendered with the spans of characters that a loss
may count: the assistant's texts and their end marks. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Roles whose text the loss counts.
TRAINED = "assistant"


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def mask_spans(turns: Column) -> Column:
    """start:end of what the loss counts, in characters of render(turns), comma-joined: each trained turn's text and end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        end = s["at"] + F.length(render_turn(t))
        head = s["at"] + F.length(t["role"]) + len(OPEN) + len(CLOSE)
        span = F.concat_ws(":", head.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def prefix_length(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in both."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prompt, prompt_turns, chosen, rejected, and their mask spans.

    turns (conv_id, turn, role, text); pairs (pair_id, conv_id, chosen), two rows a pair, chosen true and
    false. Turns are in order of turn, then role, then text; rows repeated in all four count once. Null
    text is empty, null role is `unknown`. Rows with a null conv_id and pairs that lack a side with turns
    are left out. Equal conversations give two empty completions. One conversation must fit into a row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").join(pairs.select("pair_id", "conv_id", "chosen"), "conv_id")
    side = lambda chosen: F.sort_array(F.collect_set(F.when(F.col("chosen") == chosen, turn)))
    which = lambda chosen: F.min(F.when(F.col("chosen") == chosen, F.col("conv_id")))
    both = sides.groupBy("pair_id").agg(which(True).alias("chosen_id"), which(False).alias("rejected_id"), side(True).alias("a"), side(False).alias("b"))
    return _formatted(both.where("size(a) > 0 and size(b) > 0"))


def _formatted(both: DataFrame) -> DataFrame:
    n = F.col("prompt_turns")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c), F.lit(1)))
    return (
        both.withColumn("prompt_turns", prefix_length(F.col("a"), F.col("b")))
        .withColumns({"p": F.slice("a", 1, n), "c": rest(F.col("a")), "r": rest(F.col("b"))})
        .select(
            "pair_id", "chosen_id", "rejected_id", "prompt_turns",
            render(F.col("p")).alias("prompt"),
            render(F.col("c")).alias("chosen"), mask_spans(F.col("c")).alias("chosen_mask"),
            render(F.col("r")).alias("rejected"), mask_spans(F.col("r")).alias("rejected_mask"),
        )
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs each conversation of even id (chosen) with the next id (rejected), by arithmetic alone, so without a join.

    The same as joining with pairs (pair_id = conv_id / 2), for tables that keep alternatives side by side.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ids = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    even = F.pmod("conv_id", F.lit(2)) == 0
    both = ids.groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(
        F.min(F.when(even, F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(~even, F.col("conv_id"))).alias("rejected_id"),
        F.sort_array(F.collect_set(F.when(even, F.col("t")))).alias("a"),
        F.sort_array(F.collect_set(F.when(~even, F.col("t")))).alias("b"),
    )
    return _formatted(both.where("size(a) > 0 and size(b) > 0"))


def echo_pairs(turns: DataFrame) -> DataFrame:
    """Pairs each conversation (chosen) with itself but for the last assistant turn, which repeats the first turn's text (rejected).

    pair_id, chosen_id and rejected_id are the conversation's id; conversations without an assistant turn are
    left out. Where that turn says so already, both completions are empty.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ids = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = ids.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("a"))
    from_end = F.array_position(F.reverse(F.transform("a", lambda t: t["role"] == TRAINED)), True)
    echo = lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.size("a") - F.col("e"), F.col("a")[0]["text"]).otherwise(t["text"]).alias("text"))
    both = own.withColumn("e", from_end).where("e > 0").withColumn("b", F.transform("a", echo))
    return _formatted(both.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), "a", "b"))


def shared_beginnings(turns: DataFrame) -> DataFrame:
    """(pair_id, conv_id, chosen): each conversation that begins as another does (rejected), with the least other one that shares its longest such beginning (chosen); pair_id is its own id.

    Every conversation has a chained hash for each number of first turns; hashes are joined with those that
    more than one conversation has. Of a group of any size only its two least ids are kept, so that it makes a
    row for each member and number of turns. A table without shared beginnings has no pairs.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = turns.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_set(turn)).alias("a"))
    step = lambda hs, t: F.array_append(hs, F.xxhash64(F.coalesce(F.try_element_at(hs, F.lit(-1)), F.lit(0).cast("long")), t["role"], t["text"]))
    begins = own.select("conv_id", F.posexplode(F.aggregate("a", F.array().cast("array<long>"), step)).alias("n", "h"))
    least = begins.groupBy("n", "h").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    shared = least.where("first < last").select("n", "h", "first")
    second = begins.join(shared, ["n", "h"]).where("conv_id > first").groupBy("n", "h").agg(F.min("conv_id").alias("second"))
    met = begins.join(shared.join(second, ["n", "h"]), ["n", "h"]).withColumn("other", F.when(F.col("conv_id") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    best = met.groupBy("conv_id").agg(F.max_by("other", "n").alias("other"))
    side = F.explode(F.array(F.struct(F.col("other").alias("conv_id"), F.lit(True).alias("chosen")), F.struct(F.col("conv_id"), F.lit(False).alias("chosen"))))
    return best.select(F.col("conv_id").alias("pair_id"), side.alias("s")).select("pair_id", "s.conv_id", "s.chosen")


def shared_pairs(turns: DataFrame) -> DataFrame:
    """format_pairs() of shared_beginnings()."""
    return format_pairs(turns.withColumn("conv_id", F.col("conv_id").cast("long")), shared_beginnings(turns))


def table_pairs(turns: DataFrame) -> DataFrame:
    """neighbour_pairs(), shared_pairs() and echo_pairs() of one table, told apart by `kind`: prompts of no turns for the most part, those that the table itself has, and made ones of several."""
    kinds = {"neighbour": neighbour_pairs, "shared": shared_pairs, "echo": echo_pairs}
    first, *others = (f(turns).withColumn("kind", F.lit(k)) for k, f in kinds.items())
    for more in others:
        first = first.unionByName(more)
    return first


ORACLE = """
with t as (
  select distinct conv_id, conv_id // 2 as pair_id, conv_id % 2 as side, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from t),
begins as (select conv_id, pos, list({'r': role, 't': text}) over (partition by conv_id order by pos) as b from n),
ids as (select pair_id, max(case when side = 0 then conv_id end) as chosen_id, max(case when side = 1 then conv_id end) as rejected_id
        from n group by pair_id having count(distinct side) = 2),
cmp as (select a.pair_id, a.pos, (b.pos is not null and a.role = b.role and a.text = b.text) as same
        from n a left join n b on a.pair_id = b.pair_id and b.side = 1 and a.pos = b.pos where a.side = 0),
len as (select ids.pair_id, coalesce(min(case when not same then pos end) - 1, max(pos)) as prompt_turns
        from ids join cmp on ids.pair_id = cmp.pair_id group by ids.pair_id),
r as (select n.*, l.prompt_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as body from n join len l on n.pair_id = l.pair_id),
o as (select *, coalesce(sum(length(body)) over (partition by conv_id, pos > prompt_turns order by pos rows between unbounded preceding and 1 preceding), 0) as off from r),
s as (select pair_id, side, prompt_turns,
        coalesce(string_agg(body, '' order by pos) filter (where pos <= prompt_turns), '') as prompt,
        coalesce(string_agg(body, '' order by pos) filter (where pos > prompt_turns), '') as completion,
        coalesce(string_agg(cast(off + length(role) + 5 as bigint) || ':' || cast(off + length(body) as bigint), ',' order by pos)
                 filter (where pos > prompt_turns and role = 'assistant'), '') as mask
      from o group by pair_id, side, prompt_turns)
select 'neighbour' as kind, ids.pair_id, ids.chosen_id, ids.rejected_id, cast(a.prompt_turns as integer) as prompt_turns, a.prompt,
       a.completion as chosen, a.mask as chosen_mask, b.completion as rejected, b.mask as rejected_mask
from ids join s a on ids.pair_id = a.pair_id and a.side = 0 join s b on ids.pair_id = b.pair_id and b.side = 1
union all
select 'shared', pair_id, chosen_id, pair_id, cast(prompt_turns as integer), prompt, any_value(completion) filter (where side = 0), any_value(mask) filter (where side = 0), any_value(completion) filter (where side = 1), any_value(mask) filter (where side = 1)
from (select pair_id, chosen_id, prompt_turns, side, coalesce(string_agg(body, '' order by pos) filter (where pos <= prompt_turns), '') as prompt, coalesce(string_agg(body, '' order by pos) filter (where pos > prompt_turns), '') as completion,
        coalesce(string_agg(cast(off + length(role) + 5 as bigint) || ':' || cast(off + length(body) as bigint), ',' order by pos) filter (where pos > prompt_turns and role = 'assistant'), '') as mask
      from (select w.*, n.pos, n.role, body, coalesce(sum(length(body)) over (partition by w.pair_id, w.side, n.pos > prompt_turns order by n.pos rows between unbounded preceding and 1 preceding), 0) as off
            from (select pair_id, chosen_id, prompt_turns, r.side, case r.side when 0 then chosen_id else pair_id end as conv_id
                  from (select a.conv_id as pair_id, arg_max(b.least, a.pos) as chosen_id, max(a.pos) as prompt_turns
                        from begins a join (select x.conv_id, x.pos, min(y.conv_id) as least from begins x join begins y on x.pos = y.pos and x.b = y.b and x.conv_id <> y.conv_id group by 1, 2) b
                          on a.conv_id = b.conv_id and a.pos = b.pos group by 1), range(2) r(side)) w
            join (select conv_id, pos, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as body from n) n on n.conv_id = w.conv_id) group by pair_id, chosen_id, prompt_turns, side)
group by pair_id, chosen_id, prompt_turns, prompt
union all
select 'echo', conv_id, conv_id, conv_id, cast(prompt_turns as integer),
       coalesce(string_agg(body, '' order by pos) filter (where pos <= prompt_turns), ''),
       coalesce(string_agg(body, '' order by pos) filter (where pos > prompt_turns), ''),
       coalesce(string_agg(span, ',' order by pos) filter (where pos > prompt_turns and role = 'assistant'), ''),
       coalesce(string_agg(echo, '' order by pos) filter (where pos > prompt_turns), ''),
       coalesce(string_agg(echo_span, ',' order by pos) filter (where pos > prompt_turns and role = 'assistant'), '')
from (select *, cast(off + length(role) + 5 as bigint) || ':' || cast(off + length(body) as bigint) as span,
             cast(echo_off + length(role) + 5 as bigint) || ':' || cast(echo_off + length(echo) as bigint) as echo_span
      from (select *, coalesce(sum(length(body)) over before, 0) as off, coalesce(sum(length(echo)) over before, 0) as echo_off
            from (select *, case when changed then last - 1 else n_turns end as prompt_turns
                  from (select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as body,
                               '<|' || role || '|>' || chr(10) || case when pos = last then first_text else text end || '<|end|>' || chr(10) as echo,
                               bool_or(pos = last and text <> first_text) over (partition by conv_id) as changed
                        from (select *, max(case when role = 'assistant' then pos end) over (partition by conv_id) as last, count(*) over (partition by conv_id) as n_turns,
                                     max(case when pos = 1 then text end) over (partition by conv_id) as first_text from n) where last is not null))
            window before as (partition by conv_id, pos > prompt_turns order by pos rows between unbounded preceding and 1 preceding)))
group by conv_id, prompt_turns
"""

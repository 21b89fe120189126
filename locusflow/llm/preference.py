"""Preference formatting of chat conversations: one prompt, two masked completions.

Chosen and rejected conversations of a pair are compared turn by turn. Their longest common prefix of equal
turns (role and text) is rendered once as prompt; what follows becomes the two completions, each with the
spans of its assistant turns as loss mask. All of it is built from JVM expressions. One shuffle gathers the
turns of a conversation; where rejected conversations are made up, the last answers are also put in ranges of
ids and written to the shared folder, so that no task holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: How a turn is rendered; the assistant's text and the end mark after it are what is learned.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def gather(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id`` and ``turns``, an array of (role, text) in turn order. Rows without an id or a turn number are
    left out, a null role is taken as ``user`` and a null text as empty; rows repeated entirely count once;
    of different rows with one turn number, all are kept, in order of role and text."""
    t = turns.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.filter("id is not null and turn is not null")
    return t.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("t")).select(
        "id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
    )


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Character spans [start, end) of assistant texts, with their end marks, in the rendered turns."""
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, x):
        body = acc["at"] + F.length(x["role"]) + len(OPEN.format(role=""))
        end = body + F.length(x["text"]) + len(CLOSE)
        span = F.array(F.struct((body + 0).cast("int").alias("start"), (end - 1).cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", keep: tuple[str, ...] = ()) -> DataFrame:
    """Format pairs of conversations, given as arrays of (role, text) structs.

    Returns the columns of ``keep``, ``n_shared`` (turns in the common prefix), ``prompt``,
    ``chosen_completion``, ``chosen_mask``, ``rejected_completion`` and ``rejected_mask``. Masks are arrays of
    (start, end) in characters of their completion: exactly the assistant's texts and their end marks.

    Pairs that can't teach a preference are left out: a null conversation, equal conversations, and pairs
    where a completion has no assistant turn. A null turn within a conversation is skipped; null roles and
    texts are taken as ``user`` and empty. An empty common prefix gives an empty prompt. Repeated rows give
    repeated results. No rows, no results. ``keep`` may not name a column of the result.
    """

    def clean(c):
        def fill(x):
            return F.struct(F.coalesce(x["role"], F.lit("user")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))

        return F.transform(F.filter(F.col(c), lambda x: x.isNotNull()), fill)

    made = {"n_shared", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask"}
    if clash := sorted(k for k in keep if k.lower() in made):
        raise ValueError(f"keep names columns of the result: {', '.join(clash)}; rename them first")
    p = pairs.select(*[F.col(k) for k in keep], clean(chosen_col).alias("__c"), clean(rejected_col).alias("__r")).filter("__c is not null and __r is not null")
    # the first place at which they differ, or the shorter one's end
    differ = F.array_position(F.transform(F.arrays_zip(F.col("__c").alias("c"), F.col("__r").alias("r")), lambda z: ~z["c"].eqNullSafe(z["r"])), True)
    p = p.withColumn("__n", F.when(differ > 0, differ - 1).otherwise(F.size("__c")).cast("int"))
    for side in ("__c", "__r"):
        p = p.withColumn(side + "t", F.slice(side, F.col("__n") + 1, F.size(side)))
        p = p.filter(F.exists(side + "t", lambda x: x["role"] == "assistant"))
    return p.select(
        *[F.col(k) for k in keep], F.col("__n").alias("n_shared"), _text(F.slice("__c", 1, F.col("__n"))).alias("prompt"),
        _text(F.col("__ct")).alias("chosen_completion"), _mask(F.col("__ct")).alias("chosen_mask"), _text(F.col("__rt")).alias("rejected_completion"), _mask(F.col("__rt")).alias("rejected_mask"),
    )


def preferences_from_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Preference pairs of a table that has no rejected conversations of its own.

    A conversation with an assistant turn is chosen; rejected is the same one with its last assistant turn
    answered by the last assistant turn of the conversation with the next greater id whose last answer is
    another one, without what follows it; ids may have gaps. Conversations without an assistant turn, or
    with no other answer at a greater id, make no pair. Result: the id and the columns of
    ``format_preferences``.
    """
    convs = gather(turns, id_col, turn_col, role_col, text_col)
    last = F.array_max(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)))
    convs = convs.withColumn("last", last).filter("last is not null")
    other = _next_answers(convs.select("id", F.element_at("turns", F.col("last") + 1)["text"].alias("answer")))
    pairs = convs.join(other, "id").select(
        F.col("id").alias(id_col), F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", 1, F.col("last")), F.array(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("rejected"),
    )
    return format_preferences(pairs, keep=(id_col,))


def _next_answers(answers: DataFrame) -> DataFrame:
    """``id`` and the ``answer`` of the next greater id that has another one than this id's."""
    spark = answers.sparkSession
    ranges = answers.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").withColumn("part", F.spark_partition_id())
    back = Window.partitionBy("part").orderBy(F.desc("id"))
    a = materialize(ranges, "answers").withColumn("after", F.lag("answer").over(back))
    a = a.withColumn("next", F.last(F.when(F.col("after") != F.col("answer"), F.col("after")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    # a range's first answer and its first other one; from the last range to the first: the two that follow each
    ends, follow = a.groupBy("part").agg(F.min_by("answer", "id").alias("one"), F.min_by("next", "id").alias("two")).orderBy(F.desc("part")).collect(), []
    one = two = None
    for r in ends:  # one row a range
        follow.append((r["part"], one, two))
        one, two = r["one"], r["two"] if r["two"] is not None else one if one != r["one"] else two
    follow = F.broadcast(spark.createDataFrame(follow, "part int, one string, two string"))
    found = F.coalesce("next", F.when(F.col("one") != F.col("answer"), F.col("one")).otherwise(F.col("two")))
    return a.join(follow, "part").select("id", found.alias("answer")).filter("answer is not null")


#: Turn by turn, in DuckDB.
SQL = r"""
with t as (select distinct conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
n as (select *, row_number() over (partition by conv_id order by turn, role, text) as i from t),
l as (select conv_id, max(i) as last from n where role = 'assistant' group by 1),
a as (select n.conv_id, text as answer from n join l on n.conv_id = l.conv_id and n.i = l.last),
p as (select l.conv_id, l.last, arg_min(b.answer, b.conv_id) as answer from l join a using (conv_id) join a b on b.conv_id > a.conv_id and b.answer <> a.answer group by 1, 2),
r as (select conv_id, i, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as s, length(role) + 5 as body from n),
s as (select p.conv_id, r.i < p.last as shared, r.i, r.s, r.body, r.role from p join r using (conv_id)),
c as (select *, sum(length(s)) over (partition by conv_id, shared order by i) - length(s) as pos from s)
select p.conv_id, (p.last - 1)::int as n_shared,
  coalesce(string_agg(c.s, '' order by c.i) filter (c.shared), '') as prompt,
  string_agg(c.s, '' order by c.i) filter (not c.shared) as chosen_completion,
  list({'start': (c.pos + c.body)::int, 'end': (c.pos + length(c.s) - 1)::int} order by c.i) filter (not c.shared and c.role = 'assistant') as chosen_mask,
  '<|assistant|>' || chr(10) || any_value(p.answer) || '<|end|>' || chr(10) as rejected_completion,
  [{'start': 14, 'end': (14 + length(any_value(p.answer)) + 7)::int}] as rejected_mask
from p join c using (conv_id) group by p.conv_id, p.last
"""

"""Quotation linking, in DataFrame functions alone.

A message is split into runs of lines of one quote level (the number of leading ``>`` marks). Quoted runs, and each of
their lines, are normalised and hashed and looked up among the messages of the same conversation, each indexed under the
whole of its own text, its paragraphs and its lines. Of the messages that hold a passage the earliest is its original.
A message replies to the latest original of what it quotes at level one; without such a link it follows the turn before.
``conversations`` gives the messages without quotes and the lines that announce them, each with the turn that it answers,
the turn that began its thread and the number of replies between: ordered by root, depth and turn, a conversation's rows are
its threads in the order of replies. Threads are followed by doubling: each round a message learns its ancestor's ancestor,
in joins on conversation and turn, so there are as many rounds as the longest thread's length has binary digits.

Results on odd input: a null text counts as empty; a null conv_id or turn takes part in no link; blank passages link
nothing; a passage that occurs in several messages links to the earliest; repeated rows are kept, each with the same
links; no conversation is collected into one row or task, whatever its length; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import written

MARKS = r"^(?:[ \t]*>)+"
QUOTED = r"(?:^|\n)[ \t]*>"
#: A line that announces the quote behind it.
ANNOUNCED = r"^[ \t]*(?:On|Am|Le|El) [^\n]*(?:wrote|schrieb|a écrit|escribió)[^\n]{0,40}:[ \t\r]*$"
SALTS = 32


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _own(text: Column) -> Column:
    """The lines without quote marks, and without those that announce a quote; a text without quotes as it is."""
    lines = F.split(text, "\n")
    said = lambda line, after: line.rlike(ANNOUNCED) & F.coalesce(after.rlike(MARKS), F.lit(False))
    kept = F.filter(F.arrays_zip(lines.alias("line"), F.slice(lines, F.lit(2), F.size(lines)).alias("after")), lambda x: ~x["line"].rlike(MARKS) & ~said(x["line"], x["after"]))
    return F.when(text.rlike(QUOTED), F.trim(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level and normalised text of the quoted runs and of their lines."""
    quoted = messages.filter(F.col("text").rlike(QUOTED)).select("conv_id", "turn", "text").distinct().withColumn("__id", F.xxhash64("conv_id", "turn", "text"))
    lines = quoted.select("__id", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.select("__id", "conv_id", "turn", "pos", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("line", MARKS, "").alias("line"))
    order = W.partitionBy("__id", "conv_id", "turn").orderBy("pos")  # a message's own lines
    lines = lines.withColumn("__new", F.when(F.col("level") == F.lag("level").over(order), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order)).filter("level > 0")
    runs = lines.groupBy("__id", "conv_id", "turn", "__run", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    runs = runs.select("conv_id", "turn", "level", F.array_join(F.col("lines.line"), "\n").alias("passage"))
    both = runs.unionByName(lines.select("conv_id", "turn", "level", F.col("line").alias("passage")))
    return both.withColumn("passage", normal(F.col("passage"))).filter("passage <> ''").distinct()


def _index(messages: DataFrame) -> DataFrame:
    """conv_id, hash and first turn of what messages hold themselves: whole, by paragraph and by line."""
    own = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", _own(F.coalesce("text", F.lit(""))).alias("own"))
    units = own.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", "\n")))).alias("unit"))
    units = units.select("conv_id", "turn", normal(F.col("unit")).alias("unit")).filter("unit <> ''")
    return units.groupBy("conv_id", F.sha2("unit", 256).alias("hash")).agg(F.min("turn").alias("original"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash and original: the quoted passages that were found in an earlier message."""
    quotes = passages(messages).select("conv_id", "turn", "level", F.sha2("passage", 256).alias("hash"))
    # only conversations with quotes are indexed; one that has a large part of all messages is spread over the salts
    asked = quotes.select("conv_id").distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = messages.withColumn("__salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    index = _index(spread.join(asked, ["conv_id", "__salt"], "left_semi"))
    return quotes.join(index, ["conv_id", "hash"]).filter("original < turn")


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root and depth. replies: conv_id, turn and reply_to (null where a thread begins), a row for each turn."""
    own = replies.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("root"), F.col("reply_to").isNotNull().cast("int").alias("depth"))
    full = written(own.withColumn("settled", F.lit(False)), "threads")
    while not full.filter("not settled").isEmpty():  # only rows whose ancestor does not begin a thread are joined again
        up = full.filter("depth > 0").select("conv_id", F.col("turn").alias("root"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
        on = full.filter("not settled").join(up, ["conv_id", "root"], "left")
        on = on.select("conv_id", "turn", F.coalesce("__root", "root").alias("root"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.col("__root").isNull().alias("settled"))
        full = full.filter("settled").unionByName(written(on, "threads"))
    return full.drop("settled")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, reply_to, link (quote, previous or none), n_quotes, max_level, and the root
    and depth of the thread (its own turn and 0 for a message without conversation or turn)."""
    own = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    found = links(own).groupBy("conv_id", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("original"))).alias("__quoted"), F.countDistinct("level", "hash").alias("__n"))
    turns = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("__follows")).filter("conv_id is not null and turn is not null").distinct()
    marks = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")))
    out = own.withColumn("__level", F.array_max(marks)).withColumn("text", _own(F.coalesce("text", F.lit(""))))
    out = out.join(turns, ["conv_id", "turn"], "left").join(found, ["conv_id", "turn"], "left")
    previous = F.when(F.col("__follows"), F.col("turn") - 1)
    out = out.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.coalesce("__quoted", previous).alias("reply_to"),
        F.when(F.col("__quoted").isNotNull(), "quote").when(previous.isNotNull(), "previous").otherwise("none").alias("link"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("__level", F.lit(0)).cast("int").alias("max_level"),
    )
    out = written(out, "replies")
    followed = threads(out.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "reply_to").distinct())
    known = out.filter("conv_id is not null and turn is not null").join(followed, ["conv_id", "turn"])
    return known.select(*out.columns, "root", "depth").unionByName(out.filter("conv_id is null or turn is null").select("*", F.col("turn").alias("root"), F.lit(0).alias("depth")))


def chat(messages: DataFrame, form: str = "<|{role}|>\n{text}<|end|>\n") -> DataFrame:
    """conversations with a column chat: each message in a template, ready to be joined in the order of turns."""
    head, _, rest = form.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    return conversations(messages).withColumn("chat", F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), F.col("text"), F.lit(tail)))


SQL = r"""
with recursive m as (select conv_id::bigint conv_id, turn::bigint turn, role, coalesce(text, '') text from conversations),
lines as (select distinct conv_id, turn, text, i pos, string_split(text, chr(10))[i] line from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from (select distinct conv_id, turn, text from m))),
marked as (select conv_id, turn, text, pos, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+', 0), '[^>]', '', 'g')) lev, regexp_replace(line, '^(?:[ \t]*>)+', '') line from lines),
steps as (select *, case when lev = lag(lev) over (partition by conv_id, turn, text order by pos) then 0 else 1 end fresh from marked),
runs as (select *, sum(fresh) over (partition by conv_id, turn, text order by pos) run from steps),
passages as (
  select conv_id, turn, lev, string_agg(line, chr(10) order by pos) p from runs where lev > 0 group by conv_id, turn, text, run, lev
  union all select conv_id, turn, lev, line from runs where lev > 0),
quotes as (select distinct conv_id, turn, lev, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) p from passages),
seen as (select *, lev = 0 and not (coalesce(lead(lev) over (partition by conv_id, turn, text order by pos), 0) > 0 and regexp_matches(line, '""" + ANNOUNCED + r"""')) stays from runs),
own as (select distinct conv_id, turn, text, case when max(lev) = 0 then text else trim(coalesce(string_agg(line, chr(10) order by pos) filter (stays), ''), ' ') end own, max(lev) max_level from seen group by conv_id, turn, text),
units as (select conv_id, turn, unnest([own] || regexp_split_to_array(own, '\n\s*\n') || string_split(own, chr(10))) u from own),
idx as (select conv_id, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) p, min(turn) original from units group by all),
links as (select q.conv_id, q.turn, max(original) filter (lev = 1) quoted, count(distinct (lev, p)) n from quotes q join idx using (conv_id, p) where original < q.turn and p <> '' group by all),
res as (select m.conv_id, m.turn, m.role, o.own as text, coalesce(l.quoted, case when f.conv_id is not null then m.turn - 1 end) reply_to,
  case when l.quoted is not null then 'quote' when f.conv_id is not null then 'previous' else 'none' end as link, coalesce(l.n, 0)::bigint n_quotes, coalesce(o.max_level, 0)::integer max_level
from m left join own o on m.conv_id = o.conv_id and m.turn = o.turn and m.text = o.text
left join links l on m.conv_id = l.conv_id and m.turn = l.turn
left join (select distinct conv_id, turn + 1 turn from m) f on m.conv_id = f.conv_id and m.turn = f.turn),
n as (select distinct conv_id, turn, reply_to from res where conv_id is not null and turn is not null),
walk as (select conv_id, turn, turn root, 0 as depth from n where reply_to is null union all select n.conv_id, n.turn, w.root, w.depth + 1 from n join walk w on n.conv_id = w.conv_id and n.reply_to = w.turn)
select res.*, coalesce(w.root, res.turn) root, coalesce(w.depth, 0)::integer as depth from res left join walk w on res.conv_id = w.conv_id and res.turn = w.turn"""

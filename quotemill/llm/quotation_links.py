"""Quotation linking of messages, in DataFrame functions.

A line that begins with `>` marks is quoted, as deep as it has marks. Quoted and own lines are normalised (lower case, white
space collapsed) and hashed; a quoted line goes back to the latest earlier message of its conversation that holds it as a line
of its own. The message replies to the latest one that its shallowest linked lines go back to, else to the message before it.
In link_quotations (and its SQL) a message that doesn't reply to the one before begins a branch, so (branch, turn) is the order
of turns. reply_ordered() follows reply_to: the first reply to a message continues its branch, any other begins one, and (branch,
turn) orders a conversation so that every message comes after the one it replies to and interleaved threads stay together.
Quoted lines and the "... wrote:" line above them are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import columns, materialize

#: Turns that one window sees; carried over from block to block, so that a hot conversation is no single task's.
BLOCK = 1024
MARKS = r"^((?:[ \t]*>)+)"
WROTE = r"(?i)^[^>\n]*\b(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[ \t\r\x0b\x0c]+", " "))


def lines(text: Column) -> Column:
    """Structs (depth, body, line) of the lines; the body is empty for lines without words."""
    split = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(split, lambda x: F.struct(depth(x).alias("depth"), normalised(x).alias("body"), x.alias("line")))


def unquoted(found: Column) -> Column:
    """The own lines of lines(), without an attribution that stands right above a quotation."""
    own = F.filter(
        F.transform(found, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(found, i + 1)["depth"], F.lit(0)).alias("below"))),
        lambda y: (y["x"]["depth"] == 0) & ~((y["below"] > 0) & y["x"]["line"].rlike(WROTE)),
    )
    return F.trim(F.array_join(F.transform(own, lambda y: y["x"]["line"]), "\n"))


def latest_before(rows: DataFrame, keys: list[str], at: str, value: str, to: str) -> DataFrame:
    """rows with `to`: the largest `value` among rows of the same keys with a smaller `at`, by blocks of `at`."""
    rows = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    each = rows.groupBy(*keys, "_block").agg(F.max(value).alias("_top"))
    carried = each.withColumn("_carried", F.max("_top").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    inside = F.max(value).over(Window.partitionBy(*keys, "_block").orderBy(at).rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", inside).join(carried, [*keys, "_block"])
    return rows.withColumn(to, F.greatest("_inside", "_carried")).drop("_block", "_inside", "_carried")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Every row of messages(conv_id, turn, role, text): conv_id, turn, role, quote_depth, n_quoted, n_linked, reply_to,
    branch, text (without quotations).

    A null text is empty. Rows without conv_id or turn can't be placed: reply_to and branch are null. Rows that share
    (conv_id, turn) have the same links, from all their lines. An empty table gives an empty one; other columns play no part.
    """
    rows = columns(messages, conv_id="long", turn="long", role="string", text="string").withColumn("found", lines(F.col("text")))
    placed = rows.where("conv_id is not null and turn is not null")
    each = placed.select("conv_id", "turn", F.explode("found").alias("x")).where("x.body <> ''")
    each = each.select("conv_id", "turn", F.col("x.depth").alias("depth"), F.unhex(F.md5("x.body")).alias("key"))
    # one row for each line, message and depth, so that repeated lines count once before they are dealt out; written, since three
    # branches of the plan read it
    each = materialize(each.groupBy("conv_id", "key", "turn", "depth").agg(F.count(F.lit(1)).alias("times")))
    each = each.withColumn("own", F.when(F.col("depth") == 0, F.col("turn")))
    depths = F.transform("found", lambda x: F.when(x["body"] != "", x["depth"]).otherwise(0))
    rows = rows.select(
        "conv_id", "turn", "role",
        F.coalesce(F.array_max(depths), F.lit(0)).cast("int").alias("quote_depth"),
        F.size(F.filter(depths, lambda d: d > 0)).cast("long").alias("n_quoted"),
        unquoted(F.col("found")).alias("text"),
    )
    back = latest_before(each, ["conv_id", "key"], "turn", "own", "source").where("depth > 0 and source is not null")
    links = back.groupBy("conv_id", "turn").agg(F.sum("times").alias("n_linked"), F.max(F.struct((-F.col("depth")).alias("near"), F.col("source").alias("source"))).alias("best"))
    turns = placed.select("conv_id", "turn").distinct()
    turns = latest_before(turns.withColumn("value", F.col("turn")), ["conv_id"], "turn", "value", "before").drop("value")
    turns = turns.join(links.select("conv_id", "turn", "n_linked", F.col("best.source").alias("source")), ["conv_id", "turn"], "left")
    turns = turns.select("conv_id", "turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("source", "before").alias("reply_to"), "before")
    head = F.when(F.col("before").isNull() | (F.col("reply_to") != F.col("before")), F.col("turn"))
    turns = latest_before(turns.withColumn("head", head), ["conv_id"], "turn", "head", "earlier")
    turns = turns.select("conv_id", "turn", "n_linked", "reply_to", F.coalesce("head", "earlier").alias("branch"))
    out = rows.join(turns, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "quote_depth", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", "branch", "text")


def conversations(linked: DataFrame) -> DataFrame:
    """Reply-ordered conversations: conv_id, branch, block of turns, and up to BLOCK turns' messages (turn, role, text) in order."""
    message = F.struct("turn", "role", "text", "reply_to")
    return linked.where("branch is not null").groupBy("conv_id", "branch", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(message)).alias("messages"))


def reply_ordered(linked: DataFrame) -> DataFrame:
    """conv_id, position, branch, turn, role, reply_to, text of every row of link_quotations(): conversations in reply order.

    branch is the turn that begins it; position counts from 0 in the order of (branch, turn) within a conversation; rows that
    share (conv_id, turn) follow each other. Rows that can't be placed have neither. An empty table gives an empty one.
    """
    rows = materialize(linked.withColumnRenamed("branch", "run"))  # a run's messages reply to the one right before
    turns = rows.where("run is not null").select("conv_id", "turn", "reply_to", "run").distinct()
    first = turns.where("reply_to is not null").groupBy("conv_id", "reply_to").agg(F.min("turn").alias("turn"))
    heads = turns.where("turn = run").select("conv_id", F.col("turn").alias("head"))
    # a head that is the first reply to a message goes on with that message's run
    onward = first.join(turns.where("turn = run").select("conv_id", "turn"), ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("head"), F.col("reply_to").alias("turn"))
    onward = onward.join(turns.select("conv_id", "turn", "run"), ["conv_id", "turn"]).select("conv_id", "head", F.col("run").alias("to"))
    heads = materialize(heads.join(onward, ["conv_id", "head"], "left").select("conv_id", "head", F.coalesce("to", "head").alias("to")))
    while True:  # doubling: as many rounds as the longest chain of runs has bits
        target = heads.select("conv_id", F.col("head").alias("to"), F.col("to").alias("far"))
        further = materialize(heads.join(target, ["conv_id", "to"]).select("conv_id", "head", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        heads = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    out = rows.join(heads.select("conv_id", F.col("head").alias("run"), F.col("to").alias("branch")), ["conv_id", "run"], "left")
    out = out.withColumn("block", F.floor(F.col("turn") / BLOCK))
    keys = ["conv_id", "branch", "block"]
    counts = out.where("branch is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("branch", "block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "role", "text"))
    placed = out.where("branch is not null").withColumn("inside", inside).join(counts, keys).withColumn("position", F.col("start") + F.col("inside") - 1)
    rest = out.where("branch is null").withColumn("position", F.lit(None).cast("long"))
    return placed.select(*_ORDERED).unionByName(rest.select(*_ORDERED))


_ORDERED = ["conv_id", "position", "branch", "turn", "role", "reply_to", "text"]
_BODY = r"trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '[ \t\r\x0b\x0c]+', ' ', 'g'), ' ')"
_LINKED = rf"""
m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
l AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS depth, {_BODY} AS body FROM p),
b AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY r ORDER BY i), 0) AS below FROM l),
s AS (SELECT r, coalesce(max(depth) FILTER (body <> ''), 0)::INT AS quote_depth, count(*) FILTER (depth > 0 AND body <> '') AS n_quoted,
             trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (depth = 0 AND NOT (below > 0 AND regexp_matches(line, '(?i)^[^>\n]*\b(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$'))), ''), ' ') AS text
      FROM b GROUP BY r),
k AS (SELECT conv_id, turn, depth, body, count(*) AS times FROM l WHERE body <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
q AS (SELECT a.conv_id, a.turn, a.depth, a.times, max(o.turn) AS source FROM k a JOIN k o ON a.conv_id = o.conv_id AND a.body = o.body AND o.depth = 0 AND o.turn < a.turn
      WHERE a.depth > 0 GROUP BY a.conv_id, a.turn, a.depth, a.body, a.times),
g AS (SELECT conv_id, turn, sum(times)::BIGINT AS n_linked, arg_max(source, [-depth, source]) AS source FROM q GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
y AS (SELECT t.conv_id, t.turn, coalesce(n_linked, 0) AS n_linked, coalesce(source, before) AS reply_to, before FROM t LEFT JOIN g USING (conv_id, turn)),
h AS (SELECT *, max(CASE WHEN before IS NULL OR reply_to <> before THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS branch FROM y)
"""
ORACLE_SQL = f"""WITH {_LINKED}SELECT m.conv_id, m.turn, m.role, s.quote_depth, s.n_quoted, coalesce(h.n_linked, 0) AS n_linked, h.reply_to, h.branch, s.text
FROM m JOIN s USING (r) LEFT JOIN h ON m.conv_id = h.conv_id AND m.turn = h.turn"""
#: The root of each chain of first replies is found by walking from parent to child.
ORDERED_SQL = f"""WITH RECURSIVE {_LINKED.rstrip()},
f AS (SELECT conv_id, reply_to, min(turn) AS turn FROM y WHERE reply_to IS NOT NULL GROUP BY ALL),
o AS (SELECT y.conv_id, y.turn, y.turn AS branch FROM y LEFT JOIN f ON y.conv_id = f.conv_id AND y.turn = f.turn AND y.reply_to = f.reply_to WHERE f.turn IS NULL
      UNION ALL SELECT f.conv_id, f.turn, o.branch FROM o JOIN f ON f.conv_id = o.conv_id AND f.reply_to = o.turn),
a AS (SELECT m.conv_id, m.turn, m.role, o.branch, y.reply_to, s.text FROM m JOIN s USING (r) LEFT JOIN o ON m.conv_id = o.conv_id AND m.turn = o.turn LEFT JOIN y ON m.conv_id = y.conv_id AND m.turn = y.turn)
SELECT conv_id, CASE WHEN branch IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, branch IS NULL ORDER BY branch, turn, role NULLS FIRST, text) - 1 END AS position, branch, turn, role, reply_to, text FROM a
"""

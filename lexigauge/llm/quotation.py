r"""Chat formatting by quotation linking, in DataFrame operations only.

A line that begins with quote marks (">", with spaces between them) is quoted, as deep as it has marks. Neighbouring
lines of one depth are a passage. Passages and the unquoted parts of messages are normalised (lower case, white space
turned into one space, trimmed) and hashed; a passage links to the latest earlier message of its conversation that has
it as a line, a paragraph or its whole unquoted text. A passage of several lines that no message has so links by its
lines: the line that was said longest ago names the message that last said it, and that message must have all of them. A
message replies to the message that its shallowest linked passages quote, the latest of them. Replies belong to the
thread of what they reply to; a message without a linked passage begins a thread. A conversation is put in reply order:
threads by their first turn, inside a thread by turn, then by the hash of role and text; it is written without quotes.

A conversation is given in parts of SEGMENT messages, numbered in reply order: its parts one after the other are the
conversation, however long it is, and no part is unbounded. A message's place in that order is its place among those of
its turn, thread and hash digits plus what is before those; each of these sums runs over counts, not over messages.

Message is (conversation, turn). Defined cases: null texts are empty; messages that are empty once quotes are gone are
left out of the written text but count and have a place; null turns come first and are never quoted; null conversations
are one conversation; exactly repeated rows count once; messages that share a turn but differ come in the order of their
hashes, and links to that turn reach the turn; null roles are written as "unknown"; an attribution line above a quote is
plain text; texts of any number of lines and lines of any number of marks take time in proportion to their length; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SEGMENT = 512
#: Quote marks at the beginning of a line: a class, as a repeated group recurses in Java.
MARKS = r"^[ \t>]*>"
#: What one message of the written conversation looks like.
OPEN, CLOSE = "<|", "|>\n"
#: A line of the text that runs are found in is its depth between these, and the rest of the line; a run is lines of one depth.
A, B = r"\x01", r"\x02"
RUN = rf"(?:^|\n){A}(\d+){B}[^\n]*+(?:\n{A}\1{B}[^\n]*+)*+"
#: Blocks of turns in which the latest saying is looked up.
TURNS = 512


def normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t-\r]+", " ")))


def depth(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[ \t]", ""))


def messages(conversations: DataFrame) -> DataFrame:
    """(c, conv_id, turn, role, body, quotes, m): the unquoted text and the passages of each distinct message. c: a key of the conversation that is never null; m: a hash to order messages of a turn by."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).distinct()
    key = F.concat(F.when(F.col("conv_id").isNull(), "0").otherwise("1"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    lines = F.transform(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1), lambda x: F.concat(F.lit("\x01"), depth(x).cast("string"), F.lit("\x02"), F.regexp_replace(x, MARKS, "")))
    rows = rows.withColumns({"c": key, "marked": F.array_join(lines, "\n")})
    said = lambda r: F.regexp_replace(F.regexp_replace(r, rf"^\n?{A}\d+{B}", ""), rf"\n{A}\d+{B}", "\n")
    runs = F.transform(F.regexp_extract_all("marked", F.lit(RUN), F.lit(0)), lambda r: F.struct(F.regexp_extract(r, rf"{A}(\d+){B}", 1).cast("int").alias("d"), said(r).alias("s")))
    rows = rows.withColumn("runs", runs)
    body = F.regexp_replace(F.array_join(F.transform(F.filter("runs", lambda r: r["d"] == 0), lambda r: r["s"]), "\n"), r"^[ \t-\r]+|[ \t-\r]+$", "")
    rows = rows.select("c", "conv_id", "turn", "role", body.alias("body"), F.filter("runs", lambda r: r["d"] > 0).alias("quotes"), "text")
    return rows.withColumn("m", F.concat(F.md5(F.encode(F.concat("role", F.lit("\x1f"), "body"), "utf-8")), F.md5(F.encode("text", "utf-8")))).drop("text")


def hashed(c: Column) -> Column:
    return F.md5(F.encode(c, "utf-8"))


def lines_of(text: str) -> Column:
    """The distinct normalised lines of a text that are not blank."""
    return F.filter(F.array_distinct(F.transform(F.split(text, "\n", -1), normal)), lambda x: x != "")


def latest(asked: DataFrame, units: DataFrame) -> DataFrame:
    """asked with t: the latest turn before theirs that says their hash h, or null.

    Without pairing what a conversation says and asks again and again: inside blocks of turns by a running maximum, and
    from the blocks before by their maxima.
    """
    rest = [x for x in asked.columns if x not in ("c", "turn", "h")]
    saying = units.select("c", "turn", "h", *[F.lit(None).cast(asked.schema[x].dataType).alias(x) for x in rest], F.col("turn").alias("unit"))
    both = asked.withColumn("unit", F.lit(None).cast("long")).unionByName(saying).filter("turn is not null").withColumn("block", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy("c", "h", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("unit").over(inside)).filter("unit is null")
    blocks = both.groupBy("c", "h", "block").agg(F.max("unit").alias("last"))
    earlier = Window.partitionBy("c", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = blocks.select("c", "h", "block", F.max("last").over(earlier).alias("far"))
    return near.join(far, ["c", "h", "block"]).select(*asked.columns, F.coalesce("near", "far").alias("t"))


def links(scratch: Scratch, said: DataFrame) -> DataFrame:
    """(c, turn, reply_to, n_linked): what each message with a linked passage replies to."""
    quoted = said.filter("turn is not null").select("c", "turn", F.explode("quotes").alias("q"))
    passages = quoted.groupBy("c", "turn", F.col("q.d").alias("d"), hashed(normal(F.col("q.s"))).alias("h")).agg(F.min("q.s").alias("s"))
    passages = scratch.cut(passages.select("c", "turn", "d", "h", F.transform(lines_of("s"), hashed).alias("lines")).filter(F.size("lines") > 0), "passages")
    parts = F.filter(F.array_distinct(F.transform(F.concat(F.array("body"), F.split("body", r"\n[ \t-\r]*\n", -1), F.split("body", "\n", -1)), normal)), lambda x: x != "")
    # only conversations with a passage are searched
    searched = said.filter("turn is not null").join(passages.select("c").distinct(), "c", "left_semi")
    units = scratch.cut(searched.select("c", "turn", F.explode(F.transform(parts, hashed)).alias("h")).distinct(), "units")
    found = scratch.cut(latest(passages, units), "found")
    # by lines: the message that last said the line which was said longest ago, if it has all
    left = found.filter("t is null").filter(F.size("lines") > 1).select("c", "turn", "d", F.col("h").alias("passage"), F.size("lines").alias("n"), F.explode("lines").alias("h"))
    by_line = latest(left, units).groupBy("c", "turn", "d", "passage").agg(F.count("t").alias("told"), F.first("n").alias("n"), F.min("t").alias("t"), F.collect_set("h").alias("lines")).filter("told = n")
    held = by_line.select("c", "turn", "d", "passage", "n", "t", F.explode("lines").alias("h"))
    held = held.join(units.select("c", F.col("turn").alias("t"), "h"), ["c", "t", "h"], "left_semi").groupBy("c", "turn", "d", "passage").agg(F.count("*").alias("have"), F.first("n").alias("n"), F.first("t").alias("t")).filter("have = n")
    linked = found.filter("t is not null").select("c", "turn", "d", "t").unionByName(held.select("c", "turn", "d", "t"))
    best = linked.groupBy("c", "turn").agg(F.max(F.struct((-F.col("d")).alias("d"), F.col("t").alias("t"))).alias("b"), F.count("*").alias("n_linked"))
    return scratch.cut(best.select("c", "turn", F.col("b.t").alias("reply_to"), "n_linked"), "links")


def threads(scratch: Scratch, linked: DataFrame) -> DataFrame:
    """(c, turn, reply_to, n_linked, root): the first turn of each reply's thread, by doubling the reach of replies until none is left to follow."""
    reach = linked.withColumn("root", F.col("reply_to"))
    while True:
        step = reach.select("c", F.col("turn").alias("root"), F.col("root").alias("next"))
        further = scratch.cut(reach.join(step, ["c", "root"], "left").select("c", "turn", "reply_to", "n_linked", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "reach")
        reach = further.drop("moved")
        if further.filter("moved").isEmpty():
            return reach


def thread_messages(conversations: DataFrame) -> DataFrame:
    """(c, conv_id, turn, role, body, m, n_quotes, n_linked, reply_to, root): every distinct message with its thread."""
    scratch = Scratch(conversations.sparkSession, "quotation")
    said = scratch.cut(messages(conversations), "messages")
    placed = said.join(threads(scratch, links(scratch, said)), ["c", "turn"], "left").withColumns({"root": F.coalesce("root", "turn"), "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long")})
    return placed.select("c", "conv_id", "turn", "role", "body", "m", F.size("quotes").alias("n_quotes"), "n_linked", "reply_to", "root")


def reply_order(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """rows with place: the number of messages of their conversation before them."""
    first = lambda x: F.coalesce(F.col(x), F.lit(-(1 << 63)))  # noqa: E731  null turns come first
    rows = rows.withColumns({"_root": first("root"), "_turn": first("turn"), "_digits": F.left("m", F.lit(2))})
    rows = rows.withColumns({"_roots": F.floor(F.col("_root") / segment), "_turns": F.floor(F.col("_turn") / segment)})
    cells = rows.groupBy("c", "_roots", "_root", "_turns", "_turn", "_digits").agg(F.count("*").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    threads_ = cells.groupBy("c", "_roots", "_root", "_turns").agg(F.sum("n").alias("n"))
    groups = threads_.groupBy("c", "_roots").agg(F.sum("n").alias("n"))
    groups = groups.select("c", "_roots", before(["c"], ["_roots"]).alias("_a"))
    threads_ = threads_.select("c", "_roots", "_root", "_turns", before(["c", "_roots"], ["_root", "_turns"]).alias("_b"))
    cells = cells.select("c", "_roots", "_root", "_turns", "_turn", "_digits", before(["c", "_root", "_turns"], ["_turn", "_digits"]).alias("_c"))
    at = cells.join(threads_, ["c", "_roots", "_root", "_turns"]).join(groups, ["c", "_roots"]).select("c", "_root", "_turn", "_digits", (F.col("_a") + F.col("_b") + F.col("_c")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("c", "_root", "_turn", "_digits").orderBy("m"))
    placed = rows.drop("_roots", "_turns").withColumn("_nth", nth).join(at, ["c", "_root", "_turn", "_digits"])
    return placed.withColumn("place", F.col("_before") + F.col("_nth") - 1).drop("_root", "_turn", "_digits", "_nth", "_before")


def format_chats(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, part, n_messages, n_quotes, n_linked, chat): the written conversations, a row for each part of at most `segment` messages."""
    rows = reply_order(thread_messages(conversations), segment).withColumn("part", F.floor(F.col("place") / segment))
    grouped = rows.groupBy("c", "part").agg(
        F.first("conv_id").alias("conv_id"),
        F.count("*").alias("n_messages"),
        F.sum("n_quotes").cast("long").alias("n_quotes"),
        F.sum("n_linked").cast("long").alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("place", "role", "body"))).alias("all"),
    )
    shown = F.filter("all", lambda m: m["body"] != "")
    chat = F.array_join(F.transform(shown, lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(CLOSE), m["body"])), "\n")
    return grouped.select("conv_id", "part", "n_messages", "n_quotes", "n_linked", chat.alias("chat"))


def with_quotes(conversations: DataFrame) -> DataFrame:
    """Conversations in which messages answer by quoting, made of given ones: every second message quotes lines of earlier ones, some in two levels, some a part of a message, some what nobody said."""
    base = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    earlier = lambda n: base.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"back{n}"))
    quote = lambda c, marks: F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.concat(F.lit(marks), F.replace(x, F.lit(" "), F.lit("  ")))), "\n")
    rows = base.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left").join(earlier(3), ["conv_id", "turn"], "left")
    part = F.concat(quote(F.array_join(F.slice(F.split("back3", "\n", -1), 1, 2), "\n"), "> "), F.lit("\nAs said.\n"), F.col("text"))
    kinds = (
        (F.col("turn") % 6 == 1) & F.col("back1").isNotNull(), F.concat(quote(F.col("back1"), "> "), F.lit("\n"), F.col("text")),
        (F.col("turn") % 6 == 3) & F.col("back2").isNotNull(), F.concat(quote(F.col("back2"), ">> "), F.lit("\n> nobody said this\n"), F.col("text")),
        (F.col("turn") % 6 == 5) & F.col("back3").isNotNull(), part,
    )
    text = F.when(kinds[0], kinds[1]).when(kinds[2], kinds[3]).when(kinds[4], kinds[5]).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


#: The same in DuckDB's SQL, from a table `src0` of (conv_id, turn, role, text).
RULES = r"""
src AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS given,
         regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM src0),
keyed AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, given) AS k FROM src),
lines AS (
  SELECT k, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+', 0), '[ \t]', '', 'g')) AS d,
         regexp_replace(line, '^(?:[ \t]*>)+', '') AS s
  FROM (SELECT k, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM keyed)),
marked AS (SELECT *, CASE WHEN d = lag(d) OVER (PARTITION BY k ORDER BY i) THEN 0 ELSE 1 END AS b FROM lines),
numbered AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY i) AS run FROM marked),
runs AS (SELECT k, conv_id, turn, run, d, string_agg(s, chr(10) ORDER BY i) AS s FROM numbered GROUP BY ALL),
bodies AS (SELECT k, regexp_replace(string_agg(s, chr(10) ORDER BY run), '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS body FROM runs WHERE d = 0 GROUP BY k),
said AS (
  SELECT keyed.k, conv_id, turn, role, given, coalesce(body, '') AS body, (SELECT count(*) FROM runs WHERE runs.k = keyed.k AND d > 0) AS n_quotes
  FROM keyed LEFT JOIN bodies ON keyed.k = bodies.k),
quoted AS (SELECT row_number() OVER () AS p, * FROM (SELECT DISTINCT conv_id, turn, d, lower(trim(regexp_replace(s, '[ \t-\r]+', ' ', 'g'))) AS s, min(s) AS raw FROM runs WHERE d > 0 AND turn IS NOT NULL GROUP BY ALL) WHERE s <> ''),
units AS (
  SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(u, '[ \t-\r]+', ' ', 'g'))) AS s FROM (
    SELECT conv_id, turn, unnest([body] || regexp_split_to_array(body, '\n[ \t-\r]*\n') || string_split(body, chr(10))) AS u FROM said) WHERE turn IS NOT NULL),
whole AS (
  SELECT q.p, max(u.turn) AS t FROM quoted q JOIN units u ON q.conv_id IS NOT DISTINCT FROM u.conv_id AND q.s = u.s AND u.turn < q.turn GROUP BY q.p),
parts AS (
  SELECT DISTINCT p, conv_id, turn, lower(trim(regexp_replace(l, '[ \t-\r]+', ' ', 'g'))) AS s FROM (
    SELECT p, conv_id, turn, unnest(string_split(raw, chr(10))) AS l FROM quoted WHERE p NOT IN (SELECT p FROM whole))),
several AS (SELECT p, conv_id, count(*) AS n FROM parts WHERE s <> '' GROUP BY ALL HAVING count(*) > 1),
told AS (
  SELECT x.p, x.s, max(u.turn) AS t FROM parts x JOIN several USING (p) JOIN units u ON x.conv_id IS NOT DISTINCT FROM u.conv_id AND x.s = u.s AND u.turn < x.turn WHERE x.s <> '' GROUP BY ALL),
oldest AS (SELECT p, min(t) AS t FROM told JOIN several USING (p) GROUP BY p, n HAVING count(*) = n),
by_line AS (
  SELECT o.p, o.t FROM oldest o JOIN parts x ON x.p = o.p AND x.s <> '' JOIN several ON several.p = o.p
  JOIN units u ON u.conv_id IS NOT DISTINCT FROM x.conv_id AND u.turn = o.t AND u.s = x.s GROUP BY o.p, o.t, several.n HAVING count(*) = several.n),
found AS (SELECT q.conv_id, q.turn, q.d, f.t FROM (SELECT * FROM whole UNION ALL SELECT * FROM by_line) f JOIN quoted q USING (p)),
linked AS (SELECT conv_id, turn, count(*) AS n_linked, arg_max(t, -d * 1000000000 + t) AS reply_to FROM found GROUP BY ALL),
chase AS (
  SELECT conv_id, turn, reply_to AS root FROM linked
  UNION ALL
  SELECT c.conv_id, c.turn, l.reply_to FROM chase c JOIN linked l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.root = l.turn),
roots AS (SELECT conv_id, turn, min(root) AS root FROM chase GROUP BY ALL),
placed AS (
  SELECT s.*, coalesce(l.n_linked, 0) AS n_linked, coalesce(r.root, s.turn) AS root FROM said s
  LEFT JOIN linked l ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.turn = l.turn
  LEFT JOIN roots r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.turn = r.turn),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS FIRST, turn NULLS FIRST, md5(role || chr(31) || body), md5(given)) - 1 AS place FROM placed)
SELECT conv_id, place // 512 AS part, count(*) AS n_messages, CAST(sum(n_quotes) AS BIGINT) AS n_quotes, CAST(sum(n_linked) AS BIGINT) AS n_linked,
       coalesce(string_agg('<|' || role || '|>' || chr(10) || body, chr(10) ORDER BY place) FILTER (WHERE body <> ''), '') AS chat
FROM ordered GROUP BY ALL
"""
SQL = f"WITH RECURSIVE src0 AS (SELECT conv_id, turn, role, text FROM conversations), {RULES}"
#: Of with_quotes(), whose quotes are made here anew.
QUOTED_SQL = rf"""WITH RECURSIVE given AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
src0 AS (SELECT b.conv_id, b.turn, b.role, CASE
    WHEN b.turn % 6 = 1 AND x.text IS NOT NULL THEN '> ' || replace(replace(x.text, ' ', '  '), chr(10), chr(10) || '> ') || chr(10) || b.text
    WHEN b.turn % 6 = 3 AND y.text IS NOT NULL THEN '>> ' || replace(replace(y.text, ' ', '  '), chr(10), chr(10) || '>> ') || chr(10) || '> nobody said this' || chr(10) || b.text
    WHEN b.turn % 6 = 5 AND z.text IS NOT NULL THEN '> ' || array_to_string(string_split(replace(z.text, ' ', '  '), chr(10))[1:2], chr(10) || '> ') || chr(10) || 'As said.' || chr(10) || b.text
    ELSE b.text END AS text
  FROM given b LEFT JOIN given x ON x.conv_id = b.conv_id AND x.turn + 1 = b.turn LEFT JOIN given y ON y.conv_id = b.conv_id AND y.turn + 2 = b.turn LEFT JOIN given z ON z.conv_id = b.conv_id AND z.turn + 3 = b.turn), {RULES}"""

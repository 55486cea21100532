"""Quotation linking: messages of a conversation tied to what they quote.

DataFrame functions only.  A line's quote level is the number of > it begins
with.  Quoted passages are matched line by line: digests of normalised lines are
joined, within a conversation, to the latest earlier message that has such a
line of its own.  A message replies to the message that most of its quoted lines
of the lowest matched level come from; one that quotes nothing known replies to
the message before it.  Quotes and the lines that introduce them are then cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import drop, materialise

#: The marks at the head of a quoted line, and a line that introduces a quote; the same in Java's and RE2's syntax.
MARKS = r"^[ \t]*>[> \t]*"
INTRODUCES = r"^.*(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: Turns that are numbered together; see _before().
BUCKET = 4096
MOST_ROUNDS = 64


def _lines(text):
    """Lines of a text as (level, body)."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("body"),
            x.alias("raw"),
        ),
    )


def _plain(body):
    """A line without case, punctuation and spacing."""
    return F.trim(F.regexp_replace(F.lower(body), r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))


def _numbered(rows: DataFrame, keys: list[str], order: str, what: dict[str, F.Column]) -> DataFrame:
    """Window functions over `keys` by `order` that need the rows before: see _before() and _rank()."""
    return rows.withColumns({n: c.over(Window.partitionBy(*keys, "__b").orderBy(order)) for n, c in what.items()})


def _before(rows: DataFrame) -> DataFrame:
    """`rows` (conv, turn, distinct) with `previous`, the next smaller turn of the conversation, if any.

    Turns are dealt to buckets, so that no conversation is one task's; a bucket's first turn follows the
    greatest of the next smaller bucket."""
    rows = rows.withColumn("__b", F.floor(F.col("turn") / BUCKET))
    last = rows.groupBy("conv", "__b").agg(F.max("turn").alias("top"))
    last = last.withColumn("top", F.lag("top").over(Window.partitionBy("conv").orderBy("__b")))
    inner = _numbered(rows, ["conv"], "turn", {"previous": F.lag("turn")})
    return inner.join(last, ["conv", "__b"]).withColumn("previous", F.coalesce("previous", "top")).drop("__b", "top")


def _rank(rows: DataFrame) -> DataFrame:
    """`rows` with `position`: how many rows of the thread (conv, root) have a smaller turn, in buckets likewise."""
    rows = rows.withColumn("__b", F.floor(F.col("turn") / BUCKET))
    sizes = rows.groupBy("conv", "root", "__b").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("conv", "root").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("c", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    inner = _numbered(rows, ["conv", "root"], "turn", {"position": F.row_number()})
    return inner.join(sizes, ["conv", "root", "__b"]).withColumn("position", (F.col("position") - 1 + F.col("c")).cast("bigint")).drop("__b", "c")


def link(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scratch: list[str] | None = None) -> DataFrame:
    """(conv_id, turn, role, text, n_quoted, reply_to, by_quote, root, depth, position): one row per message.

    text has the message's own lines; n_quoted counts the quoted ones.  reply_to
    is the turn that the message answers, null for the first of a conversation;
    by_quote says whether a quote says so.  root is the first message of its
    thread, depth the number of replies from there, and position its place among
    the thread's messages: a message always stands behind the one it answers.
    A null text is empty.  Messages with a null conversation or turn are left
    out.  Of messages with the same conversation and turn, the one whose (role,
    text) comes first is kept.  Other columns are ignored.
    """
    spark = messages.sparkSession
    scratch = [] if scratch is None else scratch
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.min(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    rows = rows.select("conv", "turn", "m.role", F.explode(F.array(_lines(F.col("m.text")))).alias("lines"))
    rows = materialise(rows, keep=scratch)

    level = lambda i: F.coalesce(F.try_element_at("lines", i)["level"], F.lit(0))
    introduces = lambda x, i: x["body"].rlike(INTRODUCES) & (level(i + 2) > 0)
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~introduces(x, i))
    own_text = F.btrim(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), F.lit(" \t\n"))
    base = rows.select("conv", "turn", "role", own_text.alias("text"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("bigint").alias("n_quoted"))

    lines = rows.select("conv", "turn", F.explode("lines").alias("x")).select("conv", "turn", F.col("x.level").alias("level"), _plain(F.col("x.body")).alias("line")).where("line <> ''")
    lines = lines.withColumn("digest", F.xxhash64("line")).drop("line").distinct()
    quoted = lines.where("level > 0")
    # only what somebody of the conversation quotes is looked for
    wanted = quoted.select("conv", "digest").distinct()
    events = lines.where("level = 0").join(wanted, ["conv", "digest"], "left_semi").unionByName(quoted)
    upto = Window.partitionBy("conv", "digest").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    source = F.max(F.when(F.col("level") == 0, F.col("turn"))).over(upto)
    found = events.withColumn("source", source).where("level > 0 and source is not null")
    votes = found.groupBy("conv", "turn", "level", "source").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "source")).alias("v"))
    linked = _before(rows.select("conv", "turn")).join(best.select("conv", "turn", F.col("v.source").alias("source")), ["conv", "turn"], "left")
    linked = materialise(linked.select("conv", "turn", F.coalesce("source", "previous").alias("reply_to"), F.col("source").isNotNull().alias("by_quote")), keep=scratch)

    # pointer doubling: as many rounds as the logarithm of the deepest thread
    at = linked.select("conv", "turn", F.col("reply_to").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.coalesce("reply_to", "turn").alias("root"))
    kept: list[str] = []
    for _ in range(MOST_ROUNDS):
        at = materialise(at, keep=kept)
        if not at.where("up is not null").limit(1).count():
            break
        # only messages whose root isn't known yet are joined, in long threads alone after a few rounds
        above = at.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        step = at.where("up is not null").join(above, ["conv", "up"]).select("conv", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("r2").alias("root"))
        at = at.where("up is null").unionByName(step)
    threads = _rank(at.select("conv", "turn", "root", "depth"))
    out = base.join(linked, ["conv", "turn"]).join(threads, ["conv", "turn"])
    drop(spark, kept[:-1])
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "n_quoted", "reply_to", "by_quote", "root", "depth", "position")


def oracle_sql() -> str:
    """The same for DuckDB, over the table conversations."""
    return rf"""
        WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, coalesce(text, '')) AS r FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE r = 1),
        raw AS (SELECT conv_id, turn, role, unnest(regexp_split_to_array(text, '\r?\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS i FROM m),
        lines AS (SELECT *, length(regexp_replace(regexp_extract(raw, '{MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(raw, '{MARKS}', '') AS body FROM raw),
        marked AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) AS next_level,
            trim(regexp_replace(lower(body), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) AS line FROM lines),
        base AS (SELECT conv_id, turn, any_value(role) AS role, count(*) FILTER (WHERE level > 0) AS n_quoted,
            trim(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (regexp_matches(body, '{INTRODUCES}') AND next_level > 0)), ''), ' ' || chr(9) || chr(10)) AS text
            FROM marked GROUP BY conv_id, turn),
        own AS (SELECT DISTINCT conv_id, turn, line FROM marked WHERE level = 0 AND line <> ''),
        quoted AS (SELECT DISTINCT conv_id, turn, level, line FROM marked WHERE level > 0 AND line <> ''),
        found AS (SELECT q.conv_id, q.turn, q.level, q.line, max(o.turn) AS source FROM quoted q JOIN own o ON q.conv_id = o.conv_id AND q.line = o.line AND o.turn < q.turn GROUP BY ALL),
        votes AS (SELECT conv_id, turn, level, source, count(*) AS n FROM found GROUP BY ALL),
        best AS (SELECT conv_id, turn, source FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) AS r FROM votes) WHERE r = 1),
        linked AS (SELECT p.conv_id, p.turn, coalesce(source, previous) AS reply_to, source IS NOT NULL AS by_quote
            FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM m) p LEFT JOIN best b ON p.conv_id = b.conv_id AND p.turn = b.turn),
        tree AS (SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth FROM linked WHERE reply_to IS NULL
            UNION ALL SELECT l.conv_id, l.turn, t.root, t.depth + 1 FROM linked l JOIN tree t ON l.conv_id = t.conv_id AND l.reply_to = t.turn)
        SELECT conv_id, turn, role, text, n_quoted, reply_to, by_quote, root, depth, row_number() OVER (PARTITION BY conv_id, root ORDER BY turn) - 1 AS position
        FROM base JOIN linked USING (conv_id, turn) JOIN tree USING (conv_id, turn)"""

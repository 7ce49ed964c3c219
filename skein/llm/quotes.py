"""Chat formatting by quotation linking: quoted passages lead to the messages they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import body, spread_join, write_table

#: What stands before a quoted line: a mark for each level.
_MARKS = r"^(?:[ \t]*>)+"
#: What stands between paragraphs: line ends with nothing but white space between them.
_BLANK = r"\n[\x20\x09-\x0D]*\n"


def normalised(line: Column) -> Column:
    """Lower case, one space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds passages, (level, norms) each: the level and the normalised lines of every run of lines of one level that aren't blank.

    Only a text with a ">" is taken line by line; in any other all is level zero, and a
    passage is a paragraph.
    """
    marked = lambda x: F.regexp_extract(x, _MARKS, 0)
    line = lambda x: F.struct(F.length(F.translate(marked(x), " \t", "")).alias("level"), normalised(F.regexp_replace(x, _MARKS, "")).alias("norm"))
    lines = messages.withColumn("lines", F.when(_may_quote(), F.transform(F.split(body(), "\n"), line)))
    starts = F.expr("filter(sequence(0, size(lines) - 1), i -> i = 0 or lines[i].level <> lines[i - 1].level or (lines[i].norm = '') <> (lines[i - 1].norm = ''))")
    runs = F.expr("transform(starts, (s, j) -> slice(lines, s + 1, coalesce(get(starts, j + 1), size(lines)) - s))")
    told = F.expr("transform(filter(runs, r -> r[0].norm <> ''), r -> struct(r[0].level as level, r.norm as norms))")
    said = lambda x: F.filter(F.transform(F.split(x, "\n"), normalised), lambda n: n != "")
    paragraph = lambda x: F.struct(F.lit(0).alias("level"), said(x).alias("norms"))
    plain = F.filter(F.transform(F.split(body(), _BLANK), paragraph), lambda x: F.size(x.norms) > 0)
    split = lines.withColumn("starts", starts).withColumn("runs", runs)
    return split.withColumn("passages", F.when(_may_quote(), told).otherwise(plain)).drop("lines", "starts", "runs")


def _may_quote() -> Column:
    return F.contains(body(), F.lit(">"))


def _units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, t, p, level, whole, lines, hash): every passage p, and each line of those of several."""
    passage = parsed(messages).select("conv_id", "turn", F.xxhash64(body()).alias("t"), F.posexplode("passages").alias("p", "x"))
    one = lambda whole, lines, said: F.struct(whole.alias("whole"), lines.alias("lines"), said.alias("said"))
    whole = F.array(one(F.lit(True), F.size("x.norms"), F.array_join("x.norms", " ")))
    single = F.transform(F.when(F.size("x.norms") > 1, F.col("x.norms")).otherwise(F.slice("x.norms", 1, 0)), lambda n: one(F.lit(False), F.lit(1), n))
    unit = passage.select("conv_id", "turn", "t", "p", F.col("x.level").alias("level"), F.explode(F.concat(whole, single)).alias("u"))
    return unit.select("conv_id", "turn", "t", "p", "level", "u.whole", "u.lines", _hash(F.col("u.said")).alias("hash"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quoted lines), n_quoted, n_linked, reply_to, thread_turn, depth.

    A line that begins with ">" is quoted, at as many levels as it has marks. Quoted lines of
    one level that follow one another, blank ones aside, are a passage. Normalised and
    hashed, its lines as one text, it is joined to the first message of its conversation that
    says it as a paragraph of its own; so a passage that was wrapped anew is found. If none
    before it does, its lines are looked for one by one, among lines and paragraphs. All
    lines of what is found in an earlier message count (n_linked, whatever the level).
    reply_to is the turn that most of the lines at level one come from, the latest of
    equals. Following reply_to leads to thread_turn, in ``depth`` steps: ordered by conv_id,
    thread_turn and turn, the rows are the reply-ordered conversations, since every message
    stands behind the one it replies to.

    Blank quoted lines are dropped and never linked. Null texts are empty. Null conv_id or
    turn: the message stands alone. Rows that repeat (conv_id, turn) each stay; together
    they link as one message. No rows: no rows. Other columns are ignored.

    What very many messages say is reduced to its first turn on the map side, so the join
    is many to one, and what very many quote is dealt over several tasks; replies are followed by
    doubling, in as many rounds as the logarithm of the deepest thread.
    """
    base = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    placed = base.where("conv_id is not null and turn is not null")
    quoted = _units(placed.where(_may_quote())).where(F.col("level") > 0)
    quoted = quoted.groupBy("conv_id", "turn", "t", "p", "level", "whole", "lines", "hash").agg(F.count("*").alias("n"))
    quoted = write_table(quoted, "quoted")
    first = _units(placed).where(F.col("level") == 0).groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    found = spread_join(quoted, first, ["conv_id", "hash"]).where("origin < turn")
    # One group is one passage of one message.
    settled = found.groupBy("conv_id", "turn", "t", "p", "level").agg(
        F.max(F.when(F.col("whole"), F.struct("origin", (F.col("n") * F.col("lines")).alias("n")))).alias("all"),
        F.collect_list(F.when(~F.col("whole"), F.struct("origin", F.col("n").cast("long").alias("n")))).alias("each"),
    )
    votes = settled.select("conv_id", "turn", "level", F.explode(F.when(F.col("all").isNotNull(), F.array("all")).otherwise(F.col("each"))).alias("v"))
    votes = votes.groupBy("conv_id", "turn", F.col("v.origin").alias("origin")).agg(F.sum("v.n").alias("n"), F.sum(F.when(F.col("level") == 1, F.col("v.n")).otherwise(0)).alias("near"))
    best = votes.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), F.max(F.when(F.col("near") > 0, F.struct("near", "origin"))).getField("origin").alias("reply_to"))
    best = write_table(best, "replies")
    up = best.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("above"), F.lit(1).cast("long").alias("depth"))
    stepped = None
    while True:
        higher = up.select("conv_id", F.col("turn").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        stepped = write_table(up.join(higher, ["conv_id", "above"], "left"), "threads", instead_of=stepped)
        done = stepped.where("next is not null").isEmpty()
        up = stepped.select("conv_id", "turn", F.coalesce("next", "above").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if done:
            break
    of_lines = lambda keep: F.filter(F.split(body(), "\n"), keep)
    kept = F.when(_may_quote(), F.array_join(of_lines(lambda x: ~x.rlike(_MARKS)), "\n")).otherwise(body())
    n_quoted = F.when(_may_quote(), F.size(of_lines(lambda x: x.rlike(_MARKS)))).otherwise(0)
    own = base.select("conv_id", "turn", "role", kept.alias("text"), n_quoted.cast("long").alias("n_quoted"))
    # Rows without a conversation or turn would all meet in one task of the join.
    alone = own.where("conv_id is null or turn is null").selectExpr("*", "0L as n_linked", "cast(null as long) as reply_to", "turn as thread_turn", "0L as depth")
    out = own.where("conv_id is not null and turn is not null").join(best, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", "text", "n_quoted", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "reply_to", F.coalesce("above", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
    return out.unionByName(alone)


def reply_ordered(linked: DataFrame) -> DataFrame:
    """The rows of link_quotations in reply order, over sorted partitions."""
    return linked.orderBy("conv_id", "thread_turn", "turn")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM conversations),
l AS (
  SELECT m.*, u.line, u.pos, length(regexp_replace(regexp_extract(u.line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(u.line, '^(?:[ \t]*>)+', '') AS content
  FROM m, LATERAL (SELECT unnest(m.parts) AS line, unnest(range(1, len(m.parts) + 1)) AS pos) u),
n AS (SELECT *, trim(regexp_replace(lower(content), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
edges AS (
  SELECT *, CASE WHEN level = lag(level) OVER w AND (norm = '') = (lag(norm) OVER w = '') THEN 0 ELSE 1 END AS edge
  FROM n WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
runs AS (SELECT *, sum(edge) OVER (PARTITION BY row_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p FROM edges),
passages AS (
  SELECT row_id, conv_id, turn, p, level, string_agg(norm, ' ' ORDER BY pos) AS said, count(*) AS n_lines
  FROM runs WHERE norm <> '' GROUP BY ALL),
told AS (
  SELECT conv_id, said, turn FROM passages WHERE level = 0
  UNION ALL SELECT conv_id, norm, turn FROM runs WHERE level = 0 AND norm <> ''),
first AS (SELECT conv_id, said, min(turn) AS origin FROM told GROUP BY ALL),
wholes AS (
  SELECT q.row_id, q.p, q.conv_id, q.turn, q.level, f.origin, q.n_lines AS n
  FROM passages q JOIN first f ON q.conv_id = f.conv_id AND q.said = f.said AND f.origin < q.turn WHERE q.level > 0),
singles AS (
  SELECT r.row_id, r.p, r.conv_id, r.turn, r.level, f.origin, 1 AS n
  FROM runs r JOIN first f ON r.conv_id = f.conv_id AND r.norm = f.said AND f.origin < r.turn
  WHERE r.level > 0 AND r.norm <> '' AND NOT EXISTS (SELECT 1 FROM wholes w WHERE w.row_id = r.row_id AND w.p = r.p)),
votes AS (
  SELECT conv_id, turn, origin, sum(n) AS n, sum(CASE WHEN level = 1 THEN n ELSE 0 END) AS near
  FROM (SELECT * FROM wholes UNION ALL SELECT * FROM singles) GROUP BY ALL),
best AS (
  SELECT conv_id, turn, sum(n) AS n_linked,
         list(origin ORDER BY near DESC, origin DESC) FILTER (WHERE near > 0)[1] AS reply_to
  FROM votes GROUP BY conv_id, turn),
up AS (
  SELECT conv_id, turn, reply_to AS above, 1 AS depth FROM best WHERE reply_to IS NOT NULL
  UNION ALL
  SELECT u.conv_id, u.turn, b.reply_to, u.depth + 1 FROM up u JOIN best b ON u.conv_id = b.conv_id AND u.above = b.turn WHERE b.reply_to IS NOT NULL),
top AS (SELECT conv_id, turn, min(above) AS thread_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn),
own AS (
  SELECT row_id, conv_id, turn, role, coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (WHERE level = 0), '') AS text,
         count(*) FILTER (WHERE level > 0) AS n_quoted
  FROM l GROUP BY row_id, conv_id, turn, role)
SELECT o.conv_id, o.turn, o.role, o.text, o.n_quoted, CAST(coalesce(b.n_linked, 0) AS BIGINT) AS n_linked,
       CAST(b.reply_to AS BIGINT) AS reply_to, CAST(coalesce(t.thread_turn, o.turn) AS BIGINT) AS thread_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth
FROM own o LEFT JOIN best b ON o.conv_id = b.conv_id AND o.turn = b.turn
LEFT JOIN top t ON o.conv_id = t.conv_id AND o.turn = t.turn
"""

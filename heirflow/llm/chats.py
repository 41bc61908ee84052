"""Chat formatting by quotation linking, in DataFrame functions alone.

A line that starts with ``>`` signs is quoted at the level of their number. Runs of lines of one level
are passages; a passage, and each of its lines, is normalised (lower case, single blanks) and hashed.
Messages offer the hashes of their own text and of each own line. Within a conversation a quoted
passage links to the latest earlier message that offers its hash; the reply link of a message is the
latest one of its level-1 passages, whole passages before single lines. Following reply links gives
the first message of each thread; a conversation lists its threads by their first turn, each by
turn, so that a reply comes after what it answers, and quotes are left out.

Conversations come in parts of ``PART_ROWS`` messages by their place in that order, so that neither a long
conversation nor a thread that everyone quotes is one row. Conversations of more than one part are counted out first;
their places come from ranges of the order: a range numbers its own messages and starts after the counts of the
ranges before it; equal messages are counted, not listed.

Defined cases: null text is empty, null role is ``unknown``; a null ``turn`` is -1; null
``conv_id`` rows are one conversation; rows of equal ``conv_id`` and ``turn`` share their reply link and are
ordered by a digest of role and own text; a quote of no known message is dropped without a link; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heirflow.llm.tables import stored

#: Messages of one part.
PART_ROWS = 500
QUOTE = r"^[ \t]*(?:>[ \t]?)+"
ATTRIBUTION = r"^On .*wrote:[ \t]*$"
NO_CONVERSATION = -(1 << 62)


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def own_text(text: Column) -> Column:
    """The text without quoted lines, attributions and outer blanks."""
    kept = F.filter(F.split(text, "\n"), lambda x: (quote_level(x) == 0) & ~x.rlike(ATTRIBUTION))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def messages(chats: DataFrame) -> DataFrame:
    """``c, t`` (keys without nulls), ``role, text, own`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return chats.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("c"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("t"),
        F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text"), own_text(text).alias("own"),
    )


def passages(found: DataFrame) -> DataFrame:
    """``c, t, level, whole, key`` of quoted passages and of their lines."""
    quoting = found.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("c", "t", "text").distinct()
    lines = quoting.select("c", "t", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    of = Window.partitionBy("c", "t", "h").orderBy("at")
    lines = lines.withColumn("level", quote_level(F.col("line"))).withColumn("body", F.regexp_replace("line", QUOTE, ""))
    lines = lines.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(of), F.lit(-1))).cast("int"))
    lines = lines.withColumn("run", F.sum("new").over(of)).where("level > 0")
    runs = lines.groupBy("c", "t", "h", "run", "level").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("b"))
    whole = runs.select("c", "t", "level", F.lit(1).alias("whole"), normalised(F.array_join("b.body", " ")).alias("key"))
    single = lines.select("c", "t", "level", F.lit(0).alias("whole"), normalised(F.col("body")).alias("key"))
    return whole.union(single).where("key <> ''").distinct()


def offered(found: DataFrame) -> DataFrame:
    """``c, t, key`` of what each message says itself: all of it, and each line."""
    keys = F.array_union(F.array(normalised(F.col("own"))), F.transform(F.split("own", "\n"), normalised))
    return found.select("c", "t", F.explode(keys).alias("key")).where("key <> ''").distinct()


def reply_links(found: DataFrame) -> DataFrame:
    """``c, t, parent, quotes, linked``: reply link, number of passages and of those with an original."""
    quoted = stored(passages(found), "chat-quotes").withColumn("hash", F.xxhash64("key"))
    said = offered(found).withColumn("hash", F.xxhash64("key")).join(quoted.select("c", "hash").distinct(), ["c", "hash"], "left_semi")
    nothing = [F.lit(None).cast("int").alias(x) for x in ("level", "whole")]
    both = said.select("c", "hash", "key", "t", *nothing, F.col("t").alias("original")).union(
        quoted.select("c", "hash", "key", "t", "level", "whole", F.lit(None).cast("long").alias("original"))
    )
    # quotes come before the message's own lines of the same turn, so an original is of an earlier turn
    before = Window.partitionBy("c", "hash", "key").orderBy("t", F.col("level").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("original", F.last("original", ignorenulls=True).over(before)).where("level IS NOT NULL")
    best = F.max(F.when((F.col("level") == 1) & F.col("original").isNotNull(), F.struct("whole", "original")))
    return placed.groupBy("c", "t").agg(
        best["original"].alias("parent"), F.sum("whole").alias("quotes"),
        F.sum(F.when(F.col("original").isNotNull(), F.col("whole")).otherwise(0)).alias("linked"),
    )


def thread_roots(links: DataFrame) -> DataFrame:
    """``c, t, root``: the message at the end of the reply links; each round doubles the distance looked back."""
    known = stored(links.where("parent IS NOT NULL").select("c", "t", F.col("parent").alias("root")), "chat-roots")
    while True:
        up = known.select("c", F.col("t").alias("root"), F.col("root").alias("far"))
        moved = stored(known.join(up, ["c", "root"], "left").select("c", "t", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "chat-roots")
        known = moved.select("c", "t", "root")
        if moved.where("moved").isEmpty():
            return known


def threaded(chats: DataFrame) -> DataFrame:
    """``conv_id, turn, role, content, reply_to, root, quotes, linked`` of every row."""
    found = messages(chats)
    links = stored(reply_links(found), "chat-links")
    joined = found.join(links, ["c", "t"], "left").join(thread_roots(links), ["c", "t"], "left")
    return joined.select(
        F.nullif("c", F.lit(NO_CONVERSATION)).alias("conv_id"), F.col("t").alias("turn"), "role",
        F.col("own").alias("content"), F.col("parent").alias("reply_to"), F.coalesce("root", "t").alias("root"),
        F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("linked", F.lit(0)).alias("linked"),
    )


def long_conversations(chats: DataFrame) -> DataFrame:
    """``l_conv`` of the conversations that take more than one part."""
    sizes = chats.groupBy(F.nullif(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("l_conv")).agg(F.count(F.lit(1)).alias("size"))
    return stored(sizes.where(F.col("size") > PART_ROWS).select("l_conv"), "chat-long")


def tie_digest() -> Column:
    """Order of the messages of one turn."""
    return F.md5(F.concat("role", F.lit("\n"), "content").cast("binary"))


def with_places(rows: DataFrame) -> DataFrame:
    """Distinct rows of :func:`threaded` with ``copies`` and ``place``, that of the first copy in its conversation."""
    alike = ["conv_id", "root", "turn", "role", "content"]
    # what hangs on conv_id and turn is the same for all copies
    told = rows.groupBy(*alike).agg(
        F.count(F.lit(1)).alias("copies"), F.max("reply_to").alias("reply_to"), F.max("quotes").alias("quotes"), F.max("linked").alias("linked")
    ).withColumn("digest", tie_digest())
    order = ["root", "turn", "digest"]
    dealt = stored(told.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "chat-ranges")
    sizes = dealt.groupBy("conv_id", "range").agg(F.sum("copies").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("s_conv"), F.col("range").alias("s_range"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("range") == F.col("s_range"))
    return inside.join(starts, same).select(
        *alike, "reply_to", "quotes", "linked", "digest", "copies", (F.col("first") + F.col("inside")).alias("place")
    )


def chat_report(chats: DataFrame) -> DataFrame:
    """``conv_id, part, n_messages, n_replies, n_quotes, n_linked, chat`` of every part of a conversation."""
    found = threaded(chats)
    many = long_conversations(chats)
    is_long = F.col("conv_id").eqNullSafe(F.col("l_conv"))
    zero = F.lit(0).cast("long")
    rows = found.join(many, is_long, "left_anti").select(
        "*", tie_digest().alias("digest"), zero.alias("place"), zero.alias("part"), F.lit(1).cast("long").alias("here")
    )
    if not many.isEmpty():
        after = F.col("place") + F.col("copies")
        parts = F.sequence(F.floor(F.col("place") / PART_ROWS), F.floor((after - 1) / PART_ROWS))
        cut = with_places(found.join(many, is_long, "left_semi")).withColumn("part", F.explode(parts))
        here = F.least(after, (F.col("part") + 1) * PART_ROWS) - F.greatest("place", F.col("part") * PART_ROWS)
        rows = rows.unionByName(cut.withColumn("here", here).drop("copies"))
    piece = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit("\n"))
    rows = rows.withColumn("piece", F.repeat(piece, F.col("here").cast("int")))
    return rows.groupBy("conv_id", "part").agg(
        F.sum("here").alias("n_messages"), F.sum(F.when(F.col("reply_to").isNotNull(), F.col("here")).otherwise(0)).alias("n_replies"),
        F.sum(F.col("quotes") * F.col("here")).cast("long").alias("n_quotes"),
        F.sum(F.col("linked") * F.col("here")).cast("long").alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("place", "root", "turn", "digest", "piece"))).alias("m"),
    ).select("conv_id", "part", "n_messages", "n_replies", "n_quotes", "n_linked", F.array_join("m.piece", "").alias("chat"))


#: The same in DuckDB.
CHAT_SQL = r"""
WITH RECURSIVE m AS (
  SELECT coalesce(conv_id, -4611686018427387904) AS c, coalesce(turn, -1) AS t, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text
  FROM conversations
), lined AS (
  SELECT *, [{'pos': i, 'level': length(regexp_replace(regexp_extract(l[i], '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')),
              'body': regexp_replace(l[i], '^[ \t]*(?:>[ \t]?)+', ''),
              'raw': l[i]} FOR i IN range(1, len(l) + 1)] AS lines
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM m)
), own AS (
  SELECT c, t, role, text, lines,
         regexp_replace(array_to_string([x.raw FOR x IN lines IF x.level = 0
           AND NOT regexp_matches(x.raw, '^On .*wrote:[ \t]*$')], chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS own
  FROM lined
), quoted AS (
  SELECT c, t, text, x.pos AS pos, x.level AS level, x.body AS body,
         x.pos - row_number() OVER (PARTITION BY c, t, text, x.level ORDER BY x.pos) AS run
  FROM (SELECT DISTINCT c, t, text, unnest(lines) AS x FROM own) WHERE x.level > 0
), passages AS (
  SELECT DISTINCT * FROM (
    SELECT c, t, level, 1 AS whole, trim(lower(regexp_replace(string_agg(body, ' ' ORDER BY pos), '[ \t\r\n]+', ' ', 'g'))) AS key
    FROM quoted GROUP BY c, t, text, level, run
    UNION ALL
    SELECT c, t, level, 0, trim(lower(regexp_replace(body, '[ \t\r\n]+', ' ', 'g'))) FROM quoted
  ) WHERE key <> ''
), offered AS (
  SELECT DISTINCT c, t, key FROM (
    SELECT c, t, trim(lower(regexp_replace(own, '[ \t\r\n]+', ' ', 'g'))) AS key FROM own
    UNION ALL
    SELECT c, t, trim(lower(regexp_replace(unnest(string_split(own, chr(10))), '[ \t\r\n]+', ' ', 'g'))) FROM own
  ) WHERE key <> ''
), placed AS (
  SELECT p.c, p.t, p.level, p.whole, p.key, max(o.t) AS original
  FROM passages p LEFT JOIN offered o ON o.c = p.c AND o.key = p.key AND o.t < p.t GROUP BY ALL
), links AS (
  SELECT c, t, coalesce(max(original) FILTER (level = 1 AND whole = 1), max(original) FILTER (level = 1)) AS parent,
         sum(whole) AS quotes, sum(CASE WHEN original IS NOT NULL THEN whole ELSE 0 END) AS linked
  FROM placed GROUP BY c, t
), up AS (
  SELECT c, t, parent AS root, 1 AS far FROM links WHERE parent IS NOT NULL
  UNION ALL
  SELECT up.c, up.t, l.parent, far + 1 FROM up JOIN links l ON l.c = up.c AND l.t = up.root WHERE l.parent IS NOT NULL
), roots AS (SELECT c, t, arg_max(root, far) AS root FROM up GROUP BY c, t)
, ordered AS (
  SELECT c, role, own, parent, quotes, linked,
         row_number() OVER (PARTITION BY c ORDER BY coalesce(root, t), t, md5(role || chr(10) || own)) - 1 AS place
  FROM own LEFT JOIN links USING (c, t) LEFT JOIN roots USING (c, t)
)
SELECT nullif(c, -4611686018427387904) AS conv_id, CAST(place // 500 AS BIGINT) AS part,
       count(*) AS n_messages, count(parent) AS n_replies, CAST(sum(coalesce(quotes, 0)) AS BIGINT) AS n_quotes,
       CAST(sum(coalesce(linked, 0)) AS BIGINT) AS n_linked,
       string_agg('<|' || role || '|>' || chr(10) || own || chr(10), '' ORDER BY place) AS chat
FROM ordered
GROUP BY 1, 2
"""

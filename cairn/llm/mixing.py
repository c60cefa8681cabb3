"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: sources share `share_percent` of all words by weight; a target stops at `most` times its source's size and the
excess is shared by weight among the others. A source's documents stand in a shuffled order (by hash) as one stream of
words that is cut into blocks of `block` words; a source needs as many slots as its target has blocks, going through the
stream again where the target is larger. The sources' slots lie side by side as intervals of [0, 2^k). Slot i of the
schedule goes to the source whose interval holds the van der Corput point of i, i's k bits reversed; as these points are
a permutation of the grid, every source gets exactly the slots it needs, spread evenly over the schedule. The j-th slot
of a source takes its block j modulo its blocks; its last slot takes only what the target still lacks.

Running sums and ranks go over chunks first (hash prefixes of documents, ranges of slots) and then inside each chunk, so
that no window holds a whole source; joins are on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, cut, join_sized, tidy, wrapped

WEIGHTS, SHARE_PERCENT, MOST = (3, 1, 2), 150, 2
#: Words in a block.
BLOCK = 512
#: Slots ranked by one window, as a power of two; hexadecimal digits of the hash that deal a source's documents.
_CHUNK_BITS, _PREFIX = 16, 3
#: Pieces into which the schedule is cut to find the source of a slot by an equi join.
_CELL_BITS = 12


def targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """One row a source: rank (by code point, null last), source, source_size, target."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = cut(s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))))
    most_of = F.col("source_size") * most
    # filling up: by rising cap for each unit of weight, the first level that its own source's cap doesn't cut
    order = W.orderBy(most_of / F.col("weight"), "rank")
    share = F.sum("source_size").over(W.partitionBy(F.lit(0))) * share_percent / 100
    level = (share - (F.sum(most_of).over(order.rowsBetween(W.unboundedPreceding, 0)) - most_of)) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = s.select((most_of / F.col("weight")).alias("cap"), "rank", level.alias("level"))
    found = levels.agg(F.min(F.when(F.col("level") <= F.col("cap"), F.struct("cap", "rank", "level")))["level"].alias("level"))
    full = F.least(most_of.cast("double"), F.coalesce(F.col("level") * F.col("weight"), most_of.cast("double")))
    return s.join(F.broadcast(found)).select("rank", "source", "source_size", full.alias("target"))


def needs(t: DataFrame, block: int) -> DataFrame:
    """What each source needs of the schedule: blocks, slots, the words of its last slot (0: a whole block)."""
    goal = F.least(F.round("target").cast("long"), F.ceil("target").cast("long"))
    t = t.withColumn("goal", goal).withColumn("blocks", F.ceil(F.col("source_size") / block))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("passes", passes).withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    slots = F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)
    return t.withColumn("slots", slots).withColumn("end_words", F.when(F.col("rest") > 0, F.col("rest") - (F.ceil(F.col("rest") / block) - 1) * block).otherwise(0))


def schedule(needed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots that are in use: slot, rank (the source's), block, words (how many of the block's are taken), pass (through the stream)."""
    spark = needed.sparkSession
    total, n = needed.agg(F.sum("slots"), F.count("*")).first()
    bits = max(1, ((total or 0) - 1).bit_length())
    cell_bits = min(bits, _CELL_BITS)
    upto = F.sum("slots").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    spans = needed.where("slots > 0").withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("slots"))
    cell = lambda c: F.shiftright(c, bits - cell_bits)
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    spans = F.broadcast(spans) if (n or 0) + (1 << cell_bits) <= BROADCAST_ROWS else spans
    point = F.conv(F.reverse(F.lpad(F.bin(F.col("id")), bits, "0")), 2, 10).cast("long")
    slots = spark.range(1 << bits).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", cell(F.col("point")))
    slots = slots.join(spans, "cell").where("lo <= point and point < hi").withColumn("chunk", F.shiftright("slot", _CHUNK_BITS))
    before = slots.groupBy("rank", "chunk").agg(F.count("*").alias("in_chunk"))
    by_chunk = W.partitionBy("rank").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    before = before.select("rank", "chunk", (F.sum("in_chunk").over(by_chunk) - F.col("in_chunk")).alias("before"))
    nth = F.row_number().over(W.partitionBy("rank", "chunk").orderBy("slot")) - 1
    slots = slots.withColumn("nth", nth).join(before, ["rank", "chunk"]).withColumn("nth", F.col("nth") + F.col("before"))
    last = (F.col("nth") == F.col("slots") - 1) & (F.col("end_words") > 0)
    return slots.select(
        "slot", "rank", F.pmod("nth", "blocks").alias("block"), F.when(last, F.col("end_words")).otherwise(block).alias("words"), F.floor(F.col("nth") / F.col("blocks")).alias("pass")
    )


def streams(sized: DataFrame) -> DataFrame:
    """Documents with the place of their first word in their source's shuffled stream, as column begin."""
    d = sized.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("prefix", F.substring("hash", 1, _PREFIX))
    sums = d.groupBy("rank", "prefix").agg(F.sum("size").alias("in_prefix"))
    by_prefix = W.partitionBy("rank").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.select("rank", "prefix", (F.sum("in_prefix").over(by_prefix) - F.col("in_prefix")).alias("before"))
    inside = W.partitionBy("rank", "prefix").orderBy("hash", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return d.join(sums, ["rank", "prefix"]).withColumn("begin", F.col("before") + F.col("inside")).drop("hash", "prefix", "before", "inside")


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """How many words of each document the mix takes, repeats counted, and where in the schedule it begins to.

    Takes doc_id, text and source; other columns are not read. Returns a row per input row: doc_id, size, source_size,
    target (the source's), taken, first_slot (the first slot that takes a word of it; null if none does). A null or
    empty text has size 0 and nothing of it is taken. Documents with a null source are one source, the last. A source's
    taken words are its target rounded to a whole word; no document exceeds `most` times its size. Repeated rows are
    documents of their own; ties in the shuffled order go by doc_id, then size. Reruns agree. An empty table gives no
    rows.
    """
    out = _mixed(docs, weights, share_percent, most, block)
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"))


def _mixed(docs: DataFrame, weights, share_percent: int, most: int, block: int) -> DataFrame:
    """mix() with source, text_hash and slots: the first slot of each pass through the stream that takes a word of the row."""
    sized = tidy(docs, "doc_id", "text", "source").select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size_of(F.col("text")).alias("size"))
    sized = cut(sized).withColumn("row", F.monotonically_increasing_id())
    needed = cut(needs(targets(sized, weights, share_percent, most), block))
    ranked = join_sized(sized, needed.select("source", "rank", "source_size", "target"), "source", "left", salt="row")
    first, final = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = streams(ranked).withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, final))))
    used = schedule(needed, block).select("rank", "block", "words", "slot", "pass")
    at = F.col("begin") - F.col("block") * block
    # no slot, no words: least() would skip the null
    overlap = F.greatest(F.least(at + F.col("size"), F.coalesce("words", F.lit(0))) - F.greatest(at, F.lit(0)), F.lit(0))
    taken = pieces.join(used, ["rank", "block"], "left").withColumn("overlap", overlap)
    at_pass = [F.min(F.when((F.col("pass") == p) & (F.col("overlap") > 0), F.col("slot"))) for p in range(most)]
    by = taken.groupBy("row", "doc_id", "source", "text_hash", "size", "source_size", "target")
    return by.agg(F.coalesce(F.sum("overlap"), F.lit(0)).cast("long").alias("taken"), F.array(*at_pass).alias("slots"))


def apply(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mixed corpus: rows of docs, all columns, each as often as the mix takes its words, rounded to whole documents.

    Rows stand in the order of the schedule, each copy at the first slot of its pass: partitions hold ranges of slots
    in rising order and are sorted. Documents without words are not taken. Rows that are equal in doc_id, source and
    text share their copies: each gets as many, and what is left goes to one of them.
    """
    m = _mixed(docs, weights, share_percent, most, block)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).otherwise(0).cast("long")
    m = m.select(F.struct("doc_id", "source", "text_hash").alias("same"), copies.alias("copies"), *(F.get("slots", F.lit(p)).alias(f"s{p}") for p in range(most)))
    by = m.groupBy("same").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.array_compact(F.array(*(F.min(f"s{p}") for p in range(most)))).alias("slots"))
    by = cut(by.where("copies > 0"))
    last = (by.agg(F.max(F.array_max("slots"))).first()[0] or 0) + 1
    row = F.col("row")
    rows = wrapped(docs).withColumn("same", F.struct(row["doc_id"].alias("doc_id"), row["source"].alias("source"), F.xxhash64(row["text"]).alias("text_hash")))
    rows = join_sized(rows, by, "same", "inner")
    each = rows.withColumn("times", F.floor(F.col("copies") / F.col("n")))
    repeated = by.where("n > 1 and copies % n > 0")
    if not repeated.isEmpty():
        one = rows.where("n > 1 and copies % n > 0").dropDuplicates(["same"])
        each = each.unionByName(one.withColumn("times", F.col("copies") % F.col("n")))
    each = each.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    slot = F.coalesce(F.get("slots", (F.col("copy") - 1).cast("int")), F.element_at("slots", -1))
    # slots are spread evenly over the schedule, so equal ranges of them are equal shares of the rows
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = each.select("row", slot.alias("slot"), F.col("same.text_hash").alias("tie"))
    ordered = each.repartitionById(parts, F.floor(F.col("slot") * parts / F.lit(last)).cast("int")).sortWithinPartitions("slot", "tie")
    return ordered.select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, row_number() OVER () AS rid FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, (source_size * 2)::DOUBLE / [3, 1, 2][(rank - 1) % 3 + 1] AS cap FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 150 / 100 - (sum(source_size * 2) OVER (ORDER BY cap, rank ROWS UNBOUNDED PRECEDING) - source_size * 2))::DOUBLE
         / sum(weight) OVER (ORDER BY cap, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, rank, source_size, least((source_size * 2)::DOUBLE, coalesce((SELECT level FROM l WHERE level <= cap ORDER BY cap, rank LIMIT 1) * weight, (source_size * 2)::DOUBLE)) AS target FROM w),
p AS (
  SELECT d.*, t.source_size, t.target, t.rank,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size, rid ROWS UNBOUNDED PRECEDING) - size AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT rank, (source_size + 511) // 512 AS blocks, source_size, least(round(target)::BIGINT, ceil(target)::BIGINT) AS goal FROM t WHERE source_size > 0),
q AS (SELECT *, goal // source_size AS passes, goal % source_size AS rest FROM g),
n AS (SELECT *, passes * blocks + (rest + 511) // 512 AS slots, CASE WHEN rest > 0 THEN rest - ((rest + 511) // 512 - 1) * 512 ELSE 0 END AS end_words FROM q),
span AS (SELECT *, sum(slots) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hi, sum(slots) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) - slots AS lo FROM n),
bits AS (SELECT greatest(1, length(ltrim(bin(greatest(max(hi) - 1, 1)::BIGINT), '0')))::INTEGER AS k FROM span),
points AS (SELECT i AS slot, list_sum(list_transform(range(k), lambda j: ((i >> j) & 1) << (k - 1 - j)))::BIGINT AS point FROM bits, range((1::BIGINT << (SELECT k FROM bits))) r(i)),
used AS (
  SELECT slot, rank, nth % blocks AS block, CASE WHEN nth = slots - 1 AND end_words > 0 THEN end_words ELSE 512 END AS words
  FROM (SELECT slot, span.*, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS nth FROM points JOIN span ON lo <= point AND point < hi)),
x AS (
  SELECT p.rid, slot, greatest(least(b + size - block * 512, words) - greatest(b - block * 512, 0), 0) AS overlap
  FROM (SELECT *, unnest(range((b // 512)::BIGINT, ((b + size - 1) // 512 + 1)::BIGINT)) AS blk FROM p WHERE size > 0) p JOIN used ON used.rank = p.rank AND block = blk),
s2 AS (SELECT rid, sum(overlap) AS taken, min(slot) FILTER (overlap > 0) AS first_slot FROM x GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM p LEFT JOIN s2 USING (rid)
"""

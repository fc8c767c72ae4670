"""Mixing sources to target weights with a low-discrepancy schedule.  DataFrame operations only.

Golden-ratio points are mapped through the cumulative targets, which gives every slot a source; a slot's rank
among its source's slots names the block it takes.  A source's documents, in a fixed shuffled order, form one stream
of words that is cut into blocks of equal length; ranks beyond the last block start the next pass.  A source whose
target is too few slots for that is settled by words: whole passes over its stream, and the rest of its target from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import cut

#: Words per block: the total over this many slots, within 1 and LARGEST_BLOCK; more slots only where the points' period would be passed.
SLOTS = 1 << 16
LARGEST_BLOCK = 4096
PERIOD = 1 << 31
#: Slots that a source's target must hold to be met by slots: the points and the short last block miss it by a few slots at most.
LEAST_SLOTS = 1024
#: Golden-ratio step for 32-bit points: the odd integer nearest 2^32 / 1.618...
GOLDEN = 2654435769
CELLS = 4096
CHUNK = 65536
ROWS_PER_BUCKET = 4096
#: Copies of a row that one task places at a time.
COPIES = 10_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target, lo, hi, total): the words each source should give.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A target stops at max_repeat times its source's size;
    the excess goes to the others by weight.  The level of that filling is found in closed form: sources sorted by
    cap over weight, running sums of the caps, and the first source that isn't filled.  One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("w", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * max_repeat).withColumn("total", F.sum("source_size").over(all_rows))
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - before).cast("double") / rest)
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows))
    t = t.withColumn("target", F.when(F.col("ratio") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level")))
    t = t.withColumn("target", F.coalesce("target", F.lit(0.0))).withColumn("n", F.floor("target").cast("long"))
    t = t.withColumn("hi", F.sum("n").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("lo", F.col("hi") - F.col("n"))
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    return t.select("source", "source_size", "target", "lo", F.when(last, F.col("total")).otherwise(F.col("hi")).alias("hi"), "total")


def schedule(targets: DataFrame, total: int, block: int) -> DataFrame:
    """(source, slot, rank): slot i takes the source whose interval of cumulative targets holds the i-th golden-ratio point.

    Points and intervals meet by an equality join on CELLS cells of the unit interval; ranks are counted in chunks of
    slots and added up, so that no source's slots have to lie in one task.
    """
    spark = targets.sparkSession
    slots = -(-total // block)
    frac = F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * F.lit(GOLDEN), F.lit(1 << 32))
    cell = lambda x: F.floor(x.cast("double") * CELLS / total).cast("int")
    pts = spark.range(slots).select(F.col("id").alias("slot"), F.floor(frac.cast("double") * total / (1 << 32)).cast("long").alias("x"))
    pts = pts.withColumn("cell", cell(F.col("x")))
    spans = targets.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    hit = pts.join(spans, "cell").where("x >= lo and x < hi").select("source", "slot", F.floor(F.col("slot") / CHUNK).cast("long").alias("chunk"))
    counts = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")
    counts = counts.select(F.col("source").alias("s_"), F.col("chunk").alias("c_"), ahead.alias("ahead"))
    hit = hit.withColumn("k", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    hit = hit.join(counts, F.col("source").eqNullSafe(F.col("s_")) & (F.col("chunk") == F.col("c_")))
    return hit.select("source", "slot", (F.col("ahead") + F.col("k")).alias("rank"))


def mix(docs: DataFrame, max_repeat: int = 3) -> DataFrame:
    """Words that a mix of all documents takes from each: doc_id, size, source_size, target, taken, source.

    docs needs doc_id, text, source; other columns are not read.  A null or empty text has size 0 and gives
    nothing; a null source is a source of its own, the last; repeated rows each give their words; a table
    without words has targets 0; an empty table gives no rows.  The shuffled order is that of a hash of doc_id and text; rows that are alike in both
    and in source are placed as one and told apart afterwards, so neither a doc_id of many rows nor a text of many copies fills a task.
    """
    spark = docs.sparkSession
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)).alias("h")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key).groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")))
    sized = sized.withColumn("each", F.col("size")).withColumn("size", F.col("each") * F.col("copies"))
    n, total, most = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.max("copies")).first()
    block = max(1, min(LARGEST_BLOCK, total // SLOTS), -(-total // PERIOD))
    buckets = 1
    while buckets < 65536 and n > buckets * ROWS_PER_BUCKET:
        buckets *= 2
    targets = cut(source_targets(sized, max_repeat))

    # Words ahead of each document in its source's shuffled stream: inside its bucket, plus the buckets before.
    prefix = F.conv(F.substring("h", 1, 4), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.coalesce(F.floor(prefix * buckets / 65536), F.lit(0)).cast("int"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "each").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("start", F.sum("size").over(inside) - F.col("size"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("m"))
    sums = sums.withColumn("base", F.sum("m").over(Window.partitionBy("source").orderBy("bucket")) - F.col("m"))
    t = targets.select(F.col("source").alias("t_"), "source_size", "target")
    sums = sums.join(t, F.col("source").eqNullSafe(F.col("t_"))).select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), "base", "source_size", "target")
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    # Copies one after another, in two steps, so that no task writes all of many.
    steps = placed.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    steps = steps.repartition("h", "step") if most and most > COPIES else steps
    copy = F.explode(F.sequence(F.col("step") * COPIES, F.least(F.col("copies"), (F.col("step") + 1) * COPIES) - 1)).alias("copy")
    placed = steps.select("doc_id", "source", F.col("each").alias("size"), "source_size", "target", "base", "start", copy)
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "copy", (F.col("base") + F.col("start") + F.col("copy") * F.col("size")).alias("start"))

    none = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "source")
    if not total:
        return none

    nb = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    blocks = targets.where("source_size > 0").select(F.col("source").alias("t_"), nb.alias("nb"))
    settled = F.floor("target") < LEAST_SLOTS * block
    by_slots = targets.where(~settled)
    plan = schedule(by_slots, total, block).join(blocks, F.col("source").eqNullSafe(F.col("t_"))).where(F.col("rank") < F.col("nb") * max_repeat)
    uses = plan.groupBy(F.col("source").alias("s_"), F.pmod("rank", "nb").alias("b_")).agg(F.count("*").alias("uses"))
    last = F.col("start") + F.col("size") - 1
    # Settled sources: words of whole passes, and of the rest as far as the document lies in it.
    goal, placed = F.floor("target").cast("long"), placed.where("size > 0")
    passes = F.floor(goal / F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(goal - passes * F.col("source_size") - F.col("start"), F.lit(0)))
    few = placed.where(settled).select("doc_id", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"), "source")
    pieces = placed.where(~settled).withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.greatest(F.col("start"), F.col("b") * block)
    pieces = pieces.withColumn("words", overlap).join(uses, F.col("source").eqNullSafe(F.col("s_")) & (F.col("b") == F.col("b_")), "left")
    some = pieces.groupBy("doc_id", "size", "source_size", "target", "source", "start").agg(
        F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken")
    )
    return some.select(*none.columns).union(few).union(none)


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
tot AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM sized),
blk AS (SELECT total, greatest(1, least({LARGEST_BLOCK}, total // {SLOTS}), (total + {PERIOD - 1}) // {PERIOD}) AS block FROM tot),
t0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
t1 AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM t0),
t2 AS (SELECT t1.*, tot.total, CAST(cap AS DOUBLE) / w AS ratio FROM t1, tot),
t3 AS (SELECT *, CAST(total - coalesce(CAST(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS DOUBLE)
         / CAST(sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lv FROM t2),
t4 AS (SELECT *, max(CASE WHEN lv <= ratio THEN lv END) OVER () AS level FROM t3),
t5 AS (SELECT *, coalesce(CASE WHEN ratio < level THEN CAST(cap AS DOUBLE) ELSE w * level END, 0.0) AS target FROM t4),
t6 AS (SELECT *, CAST(floor(target) AS BIGINT) AS n FROM t5),
t7 AS (SELECT *, CAST(sum(n) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi0,
         row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS is_last FROM t6),
t AS (SELECT source, source_size, target, hi0 - n AS lo, CASE WHEN is_last THEN total ELSE hi0 END AS hi, total FROM t7),
slots AS (SELECT i AS slot, CAST(floor(CAST(((i % {PERIOD}) * {GOLDEN}) % 4294967296 AS DOUBLE) * total / 4294967296) AS BIGINT) AS x
          FROM blk, LATERAL (SELECT unnest(range((total + block - 1) // block)) AS i)),
hit AS (SELECT t.source, t.source_size, row_number() OVER (PARTITION BY t.source ORDER BY slot) - 1 AS rank
        FROM slots JOIN t ON x >= lo AND x < hi),
uses AS (SELECT source, rank % ((source_size + block - 1) // block) AS b, count(*) AS uses
         FROM hit, blk WHERE rank < 3 * ((source_size + block - 1) // block) GROUP BY ALL),
placed AS (SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start,
           row_number() OVER () AS rid FROM sized),
pieces AS (SELECT rid, source, b, least(start + size, (b + 1) * block) - greatest(start, b * block) AS words
           FROM placed, blk, LATERAL (SELECT unnest(range(start // block, (start + size - 1) // block + 1)) AS b) WHERE size > 0),
taken AS (SELECT rid, CAST(sum(words * coalesce(uses, 0)) AS BIGINT) AS taken
          FROM pieces LEFT JOIN uses ON pieces.source IS NOT DISTINCT FROM uses.source AND pieces.b = uses.b GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, placed.source
FROM placed JOIN t ON placed.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (rid)
"""

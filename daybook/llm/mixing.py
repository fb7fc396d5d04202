"""Mixing sources to target weights along a low-discrepancy schedule.

Slot i of the schedule is the i-th golden-ratio point; the cumulative shares of the sources' targets say whose turn it is. The r-th
turn of a source takes the r-th block of its shuffled stream of words, starting over at the stream's end; the last block of a source is cut at
its target. A null source is a source of its own; null and empty texts have size 0, occupy no words and are taken 0 times. Repeated
rows are documents of their own. An empty table, or one without words, gives no slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.batches import columns_of, fresh, identity
from daybook.llm.order import running
from daybook.runtime import durable

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (math.sqrt(5) - 1) / 2
#: Words in a block, and slots that are ranked together.
BLOCK, CHUNK = 1024, 1 << 16
CELLS = 4096


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and the document's place in its source's shuffle (a digest of its id)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    place = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), place.alias("place"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: weight by its place in code point order (null last), size, and its target in words.

    A target stops at `most` times the size and its excess goes to the others by weight until none is above. The fixed point is reached
    directly: sources in the order of size per weight are held at their limit as long as the level of the rest lies above it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("long")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", weight.alias("weight"))
    limit = F.lit(most) * F.col("source_size")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(earlier), F.lit(0.0))
    found = sources.select("*", limit.alias("limit"), left.alias("left"), F.sum("weight").over(later).alias("rest"))
    # The first source whose limit is not below its share of the rest fixes the level for itself and all later ones.
    free = F.col("limit") * F.col("rest") > F.col("left") * F.col("weight")
    level = F.struct("left", "rest")
    found = found.withColumn("level", F.first(F.when(free, level), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    open_share = F.col("weight") * F.col("level.left") / F.col("level.rest")
    return found.select("source", "source_size", "weight", F.coalesce(open_share, F.col("limit")).alias("target"))


def _point(slot: Column) -> Column:
    """The golden-ratio point of a slot, in two parts so that large numbers of slots are not rounded."""
    low = 20
    return (F.shiftright(slot, low) * F.lit(GOLDEN * (1 << low) % 1.0) + slot.bitwiseAND(F.lit((1 << low) - 1)) * F.lit(GOLDEN)) % 1.0


def schedule(spark: SparkSession, goal: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Slots in order: slot, source, turn (from 0 within the source), words that the turn takes.

    `goal` has one row per source, `target` words and its shares. Golden-ratio points run until every source has had its turns
    (points that fall to a source beyond its last turn are passed over). Sources that the first points leave short, small ones beside large
    ones, go on with the points behind them. Turns are counted per chunk of slots and offset by chunk totals.
    """
    wanted = F.round("target").cast("long")
    shares = goal.where(F.round("target") > 0).select("source", wanted.alias("words"), F.ceil(wanted / block).alias("turns"))
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    shares = shares.select("*", F.sum("turns").over(upto).alias("high"))
    total = shares.agg(F.max("high")).first()[0]
    if not total:
        return spark.createDataFrame([], "slot long, source string, turn long, words long")
    shares = durable(shares.select("source", "words", "turns", (F.col("high") / total).alias("to"), ((F.col("high") - F.col("turns")) / total).alias("from")))
    # A source's share of the points errs by a slowly growing number of turns; the spare points cover it for most sources.
    spare = shares.count() * (8 + 4 * int(math.log2(total + 1)))
    # Points meet shares in cells of the unit interval, so no point is compared with all sources.
    cells = F.sequence(F.floor(F.col("from") * CELLS), F.floor(F.col("to") * CELLS))

    def points(start: int, end: int, sources: DataFrame) -> DataFrame:
        slots = spark.range(start, end, 1, max(1, (end - start) // (16 * chunk))).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
        given = slots.withColumn("cell", F.floor(F.col("point") * CELLS)).join(sources.withColumn("cell", F.explode(cells)), "cell")
        return given.where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("to"))).drop("point", "from", "to", "cell")

    given = durable(points(0, total + spare, shares))
    had = given.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("had"))
    short = shares.join(had, F.col("source").eqNullSafe(F.col("_s")), "left").where(F.coalesce("had", F.lit(0)) < F.col("turns")).drop("_s", "had")
    short = durable(short)
    if short.head(1):
        # Of any 1.9 / x golden-ratio points in a row, at least one falls into any interval of length x; a turn is an interval of 1 / total.
        given = given.unionByName(points(total + spare, 3 * total + spare + 8, short))
    given = given.withColumn("chunk", F.floor(F.col("slot") / chunk))
    ranked = running(durable(given), ["source"], "chunk", [F.col("slot")], F.lit(1), "turn").where(F.col("turn") < F.col("turns"))
    return ranked.select("slot", "source", "turn", F.least(F.lit(block), F.col("words") - F.col("turn") * block).alias("words"))


def stream(rows: DataFrame) -> DataFrame:
    """Add `start`: words before the document in its source's shuffled stream. Buckets of the digest keep tasks small."""
    return running(
        rows.withColumn("bucket", F.substring("place", 1, 3)), ["source"], "bucket", [F.col("place"), F.col("size")], F.col("size"), "start"
    )


def taken_words(streamed: DataFrame, slots: DataFrame, goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """Join documents to the slots that cover their words: (source, place, size, start, taken).

    A turn covers `block` words of the endless repetition of the stream. It is cut where the stream starts over, laid over the grid of
    blocks, and joined on the grid cell; documents are cut on the same grid, so every join key meets few rows.
    """
    sizes = goal.select(F.col("source").alias("_s"), F.col("source_size").alias("n"))
    covers = slots.join(sizes, F.col("source").eqNullSafe(F.col("_s"))).withColumn("at", (F.col("turn") * block) % F.col("n"))
    # One turn goes round a stream shorter than a block several times.
    rounds = F.sequence(F.lit(0), F.floor((F.col("at") + F.col("words") - 1) / F.col("n")))
    covers = covers.select("source", "n", "at", "words", F.explode(rounds).alias("round"))
    low = F.greatest(F.col("at"), F.col("round") * F.col("n")) - F.col("round") * F.col("n")
    high = F.least(F.col("at") + F.col("words"), (F.col("round") + 1) * F.col("n")) - F.col("round") * F.col("n")
    covers = covers.select("source", low.alias("low"), high.alias("high"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor((b - 1) / block)))
    covers = covers.groupBy("source", "low", "high").agg(F.count("*").alias("times"))
    covers = covers.select("source", "low", "high", "times", cells(F.col("low"), F.col("high")).alias("cell"))
    pieces = streamed.where(F.col("size") > 0).select("row", "source", "start", (F.col("start") + F.col("size")).alias("end"))
    pieces = pieces.select("*", cells(F.col("start"), F.col("end")).alias("cell"))
    other = covers.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "low", "high", "times")
    edge_low, edge_high = F.col("cell") * block, (F.col("cell") + 1) * block
    overlap = F.least("end", "high", edge_high) - F.greatest("start", "low", edge_low)
    met = pieces.join(other, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")) & (overlap > 0))
    return met.groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (of its source), taken (words, repeats counted).

    The mix takes `share` times all words. No document is taken more than `most` (rounded up) times its size; reruns agree.
    """
    spark = docs.sparkSession
    rows = durable(sized(docs, id_col, text_col, source_col))
    goal = durable(targets(rows, weights, share, most))
    streamed = stream(rows)
    # Rows alike in source, size, place and start are the same words; the start tells all others with words apart.
    row = F.struct("source", "start")
    streamed = durable(streamed.withColumn("row", row))
    taken = taken_words(streamed, schedule(spark, goal, block), goal, block).select(F.col("row.source").alias("_s"), F.col("row.start").alias("_at"), "taken")
    out = streamed.join(
        taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_at")) & (F.col("size") > 0), "left"
    )
    goals = goal.select(F.col("source").alias("_g"), "source_size", "target")
    return out.join(goals, F.col("source").eqNullSafe(F.col("_g"))).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, all columns as they were.

    A source's stream ends within one document at most; that one is counted by the nearest whole number. Documents without
    words have no part in a mix of words. Rows alike in id, source and text are one document with the takes of all.
    """
    digest = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    key, mark, number = (fresh(docs.columns, x) for x in ("_id", "_mark", "_number"))
    own = F.concat_ws(":", identity(id_col), identity(source_col), digest.cast("string"))
    taken = mix(docs.withColumn(mark, own), mark, text_col, source_col, **options).where("size > 0")
    times = taken.groupBy("doc_id").agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("times")).where("times > 0")
    times = times.select(F.col("doc_id").alias(key), F.col("times").alias(number))
    # Join and row number use the same column, so the texts are shuffled once.
    once = Window.partitionBy(key).orderBy(mark)
    met = docs.withColumn(key, own).join(times, key).withColumn(mark, F.lit(0))
    met = met.withColumn(mark, F.row_number().over(once)).where(F.col(mark) == 1)
    copies = F.explode(F.sequence(F.lit(1), F.col(number).cast("int")))
    return met.select(*columns_of(docs), copies.alias(number)).select(*columns_of(docs))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3, 1, 2][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM d GROUP BY source),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
                - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_words,
             sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest FROM s),
f AS (SELECT *, first_value(CASE WHEN 2.0::DOUBLE * source_size * rest > open_words * weight THEN {'o': open_words, 'r': rest} END IGNORE NULLS)
                OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM l),
g AS (SELECT source, source_size, coalesce(weight * level.o / level.r, 2.0::DOUBLE * source_size) AS target FROM f),
p AS (SELECT d.*, g.source_size, g.target, round(g.target)::BIGINT AS goal,
             (sum(size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0::BIGINT ELSE
            (goal // source_size) * size + greatest(0, least(start + size, goal % source_size) - start) END AS taken FROM p
"""

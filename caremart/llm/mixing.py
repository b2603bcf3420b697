"""Mixing sources to target weights along a curriculum, DataFrame functions only.

Targets: all words are shared among the sources by weight; no target passes ``MAX_REPEATS`` times
its source's words, the excess is shared again by weight.  Copies: a source's documents, in a
fixed pseudo-random order, are read again and again until the target is reached; a copy whose
middle word lies beyond it is left out.  So a source's taken words miss its target by half a
document at most, and no document is taken more than ``MAX_REPEATS`` times.  Curriculum: a
source's weight runs linearly from its ``start`` to its ``stop`` share over training; the integral
of that schedule is its cumulative demand for words, and its inverse gives each copy the
training time of its middle word.  A document is taken as often as its copies have a time, and a
range sort by that time lays out the training order; a copy's rank is its place in its sorted part
behind all earlier parts.

Texts are read and counted once: the counted rows are stored.  The running sums that place documents
are made in two levels, (source, bucket of the hash) and within a bucket, so a source with a third of
all rows is never in one task; there are more buckets the more rows there are.  Parts of the training
order are ranges of (time, hash), so equal times don't meet in one either.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents
of size 0 are taken as the source's passes reach them and count no words; sources without words
have target 0; equal ids are ordered by size and text hash, equal times by the id's hash,
the id and the pass; documents that are not taken have no time and no rank; empty tables are fine;
further columns stay, in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caremart.llm.common import cut, md5_long

WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
MAX_REPEATS = 3
BUCKET_ROWS = 20_000  # rows that a bucket of a source has at most on average
# A source's weight at the start and the end of training, by its place in order, repeating.
SCHEDULES = ((1.0, 1.0), (2.0, 0.5), (0.5, 2.0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _cyclic(values, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, number, source_size, target from rows (source, source_size), one per source.

    The result of sharing the excess again and again is the level L with
    sum(min(max_repeats * size, L * weight)) = all words: sources are filled in order of
    size / weight, and L follows from the sums before and after the last full one.
    """
    order = Window.orderBy("source")
    numbered = sizes.withColumn("number", F.row_number().over(order))
    numbered = numbered.withColumn("weight", _cyclic(weights, F.col("number")).cast("long"))
    filled = Window.orderBy((F.col("source_size") / F.col("weight")), "number")
    upto = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    limit = F.lit(max_repeats) * F.col("source_size")
    full = F.coalesce(F.sum(limit).over(upto), F.lit(0))  # limits of the sources before
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    level = (F.sum("source_size").over(everything) - full) / rest
    # the level that holds is the first that doesn't fill its own source
    fits = level * F.col("weight") <= limit
    levels = numbered.withColumn("level", level).withColumn("fits", fits)
    final = F.min(F.when(F.col("fits"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "number", "level"))).over(everything)
    target = F.least(limit.cast("double"), F.coalesce(final["level"], F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "number", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def time_of(share: Column, start: Column, stop: Column) -> Column:
    """Training time in [0, 1] at which a source has been asked for ``share`` of its words:
    the inverse of the integral of a weight that runs linearly from ``start`` to ``stop``."""
    demand = share * (start + stop) / 2
    bent = (F.sqrt(start * start + 2 * (stop - start) * demand) - start) / (stop - start)
    return F.least(F.lit(1.0), F.when(F.abs(stop - start) < 1e-9, share).otherwise(bent))


def mix(docs: DataFrame, keep: list[str], weights=WEIGHTS, max_repeats: int = MAX_REPEATS,
        schedules=SCHEDULES) -> DataFrame:
    """One row per document: ``doc`` (struct of the ``keep`` columns), size, source_size, target,
    ``positions`` (training times of its copies, ascending), copies (their number) and taken."""
    key = F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string")))
    # one never-null key that sorts as the source does, null last: joins and windows share its partitioning
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), source.alias("source"),
                       word_count(F.col("text")).alias("size"), F.col("doc_id").cast("long").alias("id"),
                       key.alias("key"), F.xxhash64("text").alias("tie"))
    rows = cut(rows, "mixing")
    # a bucket is a prefix of the hash, so buckets are in the hash's order
    digits, most = 2, rows.count()
    while most > BUCKET_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    wanted = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    inner = (Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "tie")
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(offsets.join(wanted, "source"), ["source", "bucket"])
    middle = F.col("offset") + F.col("within") + F.col("size") / 2
    copies = F.when(F.col("source_size") == 0, F.lit(1).cast("long")).otherwise(F.greatest(
        F.lit(0).cast("long"), F.least(F.lit(max_repeats).cast("long"),
                                       F.floor((F.col("target") - middle) / F.col("source_size")) + 1)))
    first, last = (_cyclic([s[i] for s in schedules], F.col("number")) for i in (0, 1))
    passes = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))
    share = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(middle + p * F.col("source_size"), F.col("target"))))
    positions = F.transform(passes, lambda p: F.coalesce(time_of(share(p), first, last), F.lit(0.0)))
    times = F.size("positions").cast("long")
    return (placed.select("doc", "size", "source_size", "target", positions.alias("positions"))
            .select("*", times.alias("copies"), (times * F.col("size")).alias("taken")))


def _in_order(each: DataFrame) -> DataFrame:
    """Copies (``id``, ``pass``, ``position`` and more), range-sorted by training time."""
    keys = ["position", md5_long(F.col("id").cast("string")), "id", "pass"]
    return each.repartitionByRange(*keys).sortWithinPartitions(*keys)


def training_order(mixed: DataFrame) -> DataFrame:
    """``doc`` and ``position`` of every copy, range-sorted by training time."""
    each = mixed.select("doc", F.col("doc.doc_id").alias("id"), F.posexplode("positions").alias("pass", "position"))
    return _in_order(each).select("doc", "position")


def ranked(mixed: DataFrame) -> DataFrame:
    """The mixed rows with ``ranks``: the places (from 0) of a document's copies in the training order.

    Only narrow rows are sorted.  A stored row's number within its part comes from the sort itself,
    the rows of all earlier parts from one sum a part.
    """
    rows = cut(mixed.withColumn("row", F.monotonically_increasing_id()), "mixed")
    each = rows.select("row", F.col("doc.doc_id").alias("id"), F.posexplode("positions").alias("pass", "position"))
    order = cut(_in_order(each).select("row", F.monotonically_increasing_id().alias("at")), "training-order")
    part = F.shiftright("at", 33)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (order.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a sorted part
             .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    within = F.col("at").bitwiseAND((1 << 33) - 1)
    ranks = (order.select("row", part.alias("part"), within.alias("within")).join(parts, "part")
             .groupBy("row").agg(F.array_sort(F.collect_list(F.col("before") + F.col("within"))).alias("ranks")))
    return (rows.join(ranks, "row", "left").drop("row")
            .withColumn("ranks", F.coalesce("ranks", F.array().cast("array<bigint>"))))

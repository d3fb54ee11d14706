"""Mixing sources to target weights by Pareto order sampling.

A source with target t and size s is taken t / s times. The whole part of it is
certain: every document gets that many copies. For the fraction left, documents
have unequal inclusion probabilities, by default the higher the longer they are (up
to twice for LONG words); in words these add up to the fraction. Documents are
ranked by the odds of a random number of their own over the odds of their inclusion
(Pareto order sampling), and the lowest ranks are taken while they fit into the
fixed number of words. One more document of the source, the one whose size fits
best, closes what is then left open.

The cut in a source's ranking comes from two rounds of counts over fixed bins of
the log rank; only the documents of one bin of one bin are ever sorted. The
decision for a document then follows from its own row and one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, settled, small, spread, text_or_empty, word_total

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Bins to a unit of the log rank, and sub-bins to a bin. The log odds of a
#: random number have density 1/4 at most, so a bin holds 1/256 of a source.
BINS, SUB_BINS = 64, 256
#: Sources up to which their table (some 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 50_000
SALTS = 64
#: Words from which on a document has twice the inclusion of an empty one.
LONG = 1000
#: Repeated identifiers up to which their list is broadcast.
BROADCAST_IDS = 100_000


def uniform(name: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of a name."""
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(2.0**52)


def repeated_ids(docs: DataFrame, doc_id: str) -> DataFrame | None:
    """The identifiers, null among them, that don't name a row alone; None if all do."""
    ids = docs.groupBy(F.col(doc_id).alias("again_id")).agg(F.count("*").alias("n"))
    again = settled(ids.where("n > 1 OR again_id IS NULL").select("again_id"))
    return None if again.isEmpty() else again


def with_random(rows: DataFrame, again: DataFrame | None, seed: str) -> DataFrame:
    """rows with a random number `u` of each row and `nth`, its number among equal rows.

    rows: doc_id, source, tie (a hash of the text) and more. An identifier of one row
    alone decides its random number. Rows that share an identifier, or have none, get
    theirs from text and source too; rows equal in all of these are numbered, first
    within parts and then over the counts of the parts. Which of them has which number
    makes no difference; the numbers do not depend on how rows lie.
    """
    first = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    alone = lambda df: df.withColumns({"nth": F.lit(0).cast("long"), "u": uniform(first)})
    if again is None:
        return alone(rows)
    own = rows.columns
    rows = rows.withColumn("row_part", F.spark_partition_id())
    some = again.where("again_id IS NOT NULL")
    if small(again, BROADCAST_IDS):
        marked = rows.join(F.broadcast(some), F.col("doc_id") == F.col("again_id"), "left")
    else:
        marked = spread(rows, some.withColumn("doc_id", F.col("again_id")), ["doc_id"], "row_part", "left")
    several = F.col("doc_id").isNull() | F.col("again_id").isNotNull()
    key = F.md5(F.to_json(F.struct("doc_id", "source", "tie"))).alias("row_key")
    many = settled(marked.where(several).select(*own, "row_part", key))
    inner = Window.partitionBy("row_key", "row_part").orderBy("row_part")
    before = Window.partitionBy("row_key").orderBy("row_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = many.groupBy("row_key", "row_part").agg(F.count("*").alias("n"))
    parts = parts.select("row_key", "row_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    many = many.withColumn("at", F.row_number().over(inner)).join(parts, ["row_key", "row_part"])
    many = many.withColumn("nth", F.col("before") + F.col("at") - 1)
    name = F.concat_ws(":", first, F.col("row_key"), F.col("nth").cast("string"))
    many = many.withColumn("u", uniform(name)).select(*own, "nth", "u")
    return alone(marked.where(~several).select(*own)).unionByName(many)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, tilted, target: weighted shares, none above most x its size.

    sizes: source, size, tilt. tilted sums up size times tilt. Sources in code point order, null last, take the weights
    in turn and share all words; what exceeds the limit is shared again by weight
    until none is above it. Works on one row per source.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("tilt")).alias("tilted")
    )
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    turn = F.pmod(nth - 1, F.lit(len(weights))) + 1
    per = per.select(
        "source",
        "source_size",
        "tilted",
        (F.col("source_size") * most).alias("cap"),
        F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long").alias("weight"),
    )
    # With caps in order of cap / weight, the capped sources are the first ones.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open": F.sum("weight").over(after),
        }
    )
    holds = F.col("left") * F.col("weight") <= F.col("cap") * F.col("open")
    level = F.min_by(F.struct("left", "open"), F.when(holds, F.struct(F.col("cap") / F.col("weight"), F.col("open") * -1)))
    per = per.withColumn("level", level.over(whole))
    share = F.col("weight") * F.col("level.left")
    return per.select(
        "source",
        "source_size",
        "tilted",
        F.when(share >= F.col("cap") * F.col("level.open"), F.col("cap").cast("double"))
        .otherwise(share.cast("double") / F.col("level.open"))
        .alias("target"),
    )


def joined(rows: DataFrame, per_source: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """rows with columns of a settled table of one row per source.

    A table within BROADCAST_SOURCES is broadcast. A larger one is repeated SALTS
    times and joined by source and salt, so that no source is one task.
    """
    right = per_source.select(F.col("source").alias("at_source"), *columns)
    match = F.col(source).eqNullSafe(F.col("at_source"))
    if small(per_source, BROADCAST_SOURCES):
        return rows.join(F.broadcast(right), match).drop("at_source")
    right = right.withColumn("at_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in rows.columns]), F.lit(SALTS)).cast("int")
    return (
        rows.withColumn("own_salt", salt)
        .join(right, match & (F.col("own_salt") == F.col("at_salt")))
        .drop("at_source", "at_salt", "own_salt")
    )


def own_rank() -> Column:
    """Log of the random odds over the inclusion odds, from a row and its source's."""
    share = F.when(F.col("tilted") > 0, F.col("rest") * F.col("tilt") / F.col("tilted")).otherwise(0.0)
    p = F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log("u") - F.log(1 - F.col("u")) - (F.log(p) - F.log(1 - p))


#: What tells rows of one rank apart.
ROW = ["doc_id", "tie", "nth"]


def facts(doc_id: str, text: str, source: str, inclusion: str | None) -> list[Column]:
    """What the decision for a row needs of it."""
    size = word_total(text)
    long = F.lit(LONG).cast("long")
    own = F.coalesce(F.col(inclusion).cast("double"), F.lit(1.0)) if inclusion else long + F.least(size, long)
    return [
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.xxhash64(text_or_empty(text)).alias("tie"),
        size.alias("size"),
        own.alias("tilt"),
    ]


def mixing_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    inclusion: str | None = None,
    weights=WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Documents with size and random number, and one row per source with the cut.

    inclusion: a positive column by which documents of a source differ in their
    chance to be taken for the fraction, null counting as 1; absent: by size.
    """
    rows = docs.select(*facts(doc_id, text, source, inclusion))
    rows = settled(with_random(rows, repeated_ids(docs, doc_id), seed))
    per = source_targets(rows, weights, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(times), F.lit(most)).cast("long")
    per = settled(
        per.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    ranked = joined(rows, per, "source", ["tilted", "rest"]).select(
        "source", *ROW, "size", "rest", own_rank().alias("rank")
    )
    for bins in (BINS, BINS * SUB_BINS):
        ranked = ranked.withColumn("bin", F.floor(F.col("rank") * bins))
        ranked = at_cut(ranked)
    order = Window.partitionBy("source").orderBy("rank", F.asc_nulls_first("doc_id"), "tie", "nth")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = (
        ranked.withColumn("running", running)
        .where(F.col("running") <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("rank", *ROW)).alias("cut"), F.min(F.col("rest") - F.col("running")).alias("gap"))
    )
    # Where not even the first document of the bin fits, the cut lies before the bin.
    floor = ranked.groupBy("source").agg(F.min("rank").alias("floor"), F.min("rest").alias("bin_gap"))
    cuts = settled(
        per.join(floor.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")), "left")
        .join(cut.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
        .withColumn("gap", F.coalesce("gap", "bin_gap"))
        .drop("s1", "s2", "bin_gap")
    )
    ranked = joined(rows, cuts, "source", [*CUT, "gap"]).withColumn("rank", own_rank())
    off = F.abs(F.col("gap") - F.col("size"))
    better = ~taken_rank() & (off < F.col("gap"))
    close = F.struct("rank", *ROW)
    closing = (
        ranked.where(better)
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), close.alias("at")))["at"].alias("closing"))
        .withColumnRenamed("source", "s3")
    )
    cuts = cuts.drop("gap").join(closing, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    return rows, settled(cuts)


def at_cut(ranked: DataFrame) -> DataFrame:
    """The rows of the bin that holds the cut, `rest` less the words before it."""
    bins = ranked.groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    hit = bins.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    hit = hit.select(F.col("source").alias("s"), F.col("bin").alias("b"), "before")
    match = F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))
    return ranked.join(hit, match).select(
        "source", *ROW, "size", (F.col("rest") - F.col("before")).alias("rest"), "rank"
    )


CUT = ["source_size", "tilted", "target", "whole", "rest", "floor", "cut"]


def taken_rank() -> Column:
    """Whether the rank lies up to the cut of the source."""
    return (
        F.when(F.col("floor").isNull(), F.col("rest") > 0)
        .when(F.col("cut").isNull(), F.col("rank") < F.col("floor"))
        .otherwise(F.struct("rank", *ROW) <= F.col("cut"))
    )


def decided(rows: DataFrame, cuts: DataFrame, most: int = MOST) -> DataFrame:
    """rows (source, ROW, u, tilt, ...) with source_size, target and copies."""
    more = taken_rank() | F.struct("rank", *ROW).eqNullSafe(F.col("closing"))
    total = F.least(F.col("whole") + more.cast("long"), F.lit(most)).cast("long")
    return joined(rows, cuts, "source", [*CUT, "closing"]).withColumn("rank", own_rank()).withColumn("copies", total)


def mix_sources(docs: DataFrame, most: int = MOST, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    size counts the words of the whole text, null counting as empty. A null source
    is a source of its own. Sources without words have target 0. Rows that share an
    identifier, or have none, are decided each on its own; of equal rows as many as
    the mix needs are taken. An empty table gives an empty result; other columns of
    docs are not looked at. The same documents always give the same mix. Long texts are
    counted whole.
    """
    rows, cuts = mixing_plan(docs, most=most, **how)
    return decided(rows, cuts, most).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        "source",
    )


def mixed_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    inclusion: str | None = None,
    most: int = MOST,
    seed: str = SEED,
    **how,
) -> DataFrame:
    """docs in their own columns, each row as often as the mix takes it.

    Texts do not move, but for rows without an identifier of their own: the copies
    follow from the row and the table of sources.
    """
    _, cuts = mixing_plan(docs, doc_id, text, source, inclusion, most=most, seed=seed, **how)
    own = fresh(docs, "mix_row")
    rows = docs.select(
        F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias(own), *facts(doc_id, text, source, inclusion)
    )
    rows = with_random(rows, repeated_ids(docs, doc_id), seed)
    taken = decided(rows, cuts, most).where(F.col("copies") > 0)
    again = taken.select(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select(f"{own}.*")

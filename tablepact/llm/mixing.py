"""Mixing sources to target weights by entropy balancing (operator 7).

Each document gets a rate, how often the mix takes it. Of all rates that meet
every source's target of words, entropy balancing takes those closest to 1 in
relative entropy, which are exponentially tilted in the document's size:
``min(limit, exp(b * size / scale))``, one dual variable ``b`` for each source. The dual is
convex; Newton's method, kept in a bracket, solves it for all sources together.
Each step is an aggregate over the cells (source, size, number of documents), which
are as many as there are different sizes, not documents.

Rates are rounded into whole copies. Within a source, cells are taken by size and
the fractional parts are carried along; what is then missing is made up by the smallest documents, so that the words taken
differ from the target by less than a small document's size. Which documents of a cell get the extra copy goes by
id, in parts of about the square root of the cell, so that a cell of many copies isn't one task's work.

Everything is DataFrame operations. The only rows not spread out are one for each source.

Cases. A null text has size 0 and is never taken; so are all documents of a source
without words. A null source is a source of its own, the last. Rows with the same
id are documents of their own. An empty table gives an empty one. A source that
stops at the limit is taken whole, ``limit`` times. Columns of the input named like those added (``ADDED``) are replaced; all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .joins import match
from .store import Scratch

ADDED = ("size", "source_size", "target", "rate", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 200
TOLERANCE = 1e-9
#: Stands for a bound that isn't known yet.
FAR = 1e18


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): ``share`` of all words dealt by weight, none above ``limit`` times its source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = limit * F.col("source_size")
    ranked = sources.withColumn("w", w).withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("w"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    # With the first sources full, the others share what is left by weight; a source is full if even its share then reaches its cap.
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = left / rest
    full = F.col("level") >= F.col("full_at")
    return (
        ranked.withColumn("level", level)
        .withColumn("open_level", F.min(F.when(~full, F.struct("full_at", "level"))).over(everything)["level"])
        .withColumn("target", F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("open_level"))))
        .select("source", "source_size", "target")
    )


def solve(cells: DataFrame, goals: DataFrame, limit: float, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """(source, b, scale): the dual variable of each source with a target between nothing and its limit, by safeguarded Newton steps over the cells.

    A step that would leave the bracket, or go too far, halves it instead. Raises if that hasn't come to an end after ``steps``.
    """
    scales = cells.filter("size > 0").groupBy("source").agg((F.sum(F.col("m") * F.col("size") * F.col("size")) / F.sum(F.col("m") * F.col("size"))).alias("scale"))
    state = (
        match(scales, goals.filter((F.col("target") > 0) & (F.col("target") < limit * F.col("source_size"))), ["source"])
        .select("source", "scale", "target", "source_size", F.log(F.col("target") / F.col("source_size")).alias("b"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"), F.lit(False).alias("done"))
    )
    state = scratch.table(state, "dual")
    for _ in range(steps):
        if state.filter(~F.col("done")).isEmpty():
            return state.select("source", "b", "scale")
        rate = F.least(F.lit(limit), F.exp(F.least(F.col("b") * F.col("size") / F.col("scale"), F.lit(50.0))))
        words = F.col("m") * F.col("size") * rate
        slope = F.when(rate < limit, words * F.col("size") / F.col("scale")).otherwise(0.0)
        got = (
            match(cells, state.filter(~F.col("done")), ["source"])
            .groupBy("source", "scale", "target", "source_size", "b", "lo", "hi")
            .agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
        )
        miss = F.col("got") - F.col("target")
        near = F.abs(miss) <= TOLERANCE * F.col("target")
        step = (
            got.withColumn("hi", F.when(miss > 0, F.col("b")).otherwise(F.col("hi")))
            .withColumn("lo", F.when(miss < 0, F.col("b")).otherwise(F.col("lo")))
            .withColumn("newton", F.when(F.col("slope") > 0, F.col("b") - miss / F.col("slope")))
            .withColumn("middle", F.when(F.col("lo") <= -FAR, F.col("hi") * 2 - 1).when(F.col("hi") >= FAR, F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2))
            .withColumn("inside", (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")) & (F.abs(F.col("newton") - F.col("b")) <= 1 + F.abs(F.col("b"))))
            .withColumn("next", F.when(near, F.col("b")).when(F.coalesce("inside", F.lit(False)), F.col("newton")).otherwise(F.col("middle")))
            # A bracket that doubles can't halve any further is as near as they come.
            .select("source", "scale", "target", "source_size", F.col("next").alias("b"), "lo", "hi", (near | (F.col("hi") - F.col("lo") <= 1e-15 * F.abs("b"))).alias("done"))
        )
        state, old = scratch.table(step.unionByName(state.filter("done")), "dual"), state
        scratch.drop(old)
    if not state.filter(~F.col("done")).isEmpty():
        raise RuntimeError(f"the dual of {state.filter(~F.col('done')).count()} sources did not converge in {steps} steps")
    return state.select("source", "b", "scale")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: int = 2, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken (words).

    ``weights`` repeat over the sources by code point; ``share`` of all words is dealt
    out; ``limit`` bounds a source's target and a document's copies.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop(*ADDED).withColumn("size", n_words(F.col(text)))
    cells = scratch.table(docs.groupBy(F.col(source).alias("source"), "size").agg(F.count("*").alias("m")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).cast("long").alias("source_size"))
    goals = scratch.table(targets(sources, weights, share, limit), "targets")
    dual = solve(cells, goals, float(limit), scratch)

    full = F.col("target") >= limit * F.col("source_size")
    rated = (
        match(match(cells, goals, ["source"]), dual, ["source"], "left")
        .select("source", "size", "m", "source_size", "target", F.when(F.col("size") == 0, 0.0).when(full, float(limit)).when(F.col("b").isNull(), 0.0).otherwise(F.least(F.lit(float(limit)), F.exp(F.least(F.col("b") * F.col("size") / F.col("scale"), F.lit(50.0))))).alias("rate"))
        .withColumn("base", F.floor("rate").cast("long"))
    )
    # Carried from the smallest size to the largest, so that each cell's sum of extra copies is off by less than one.
    up = W.partitionBy("source").orderBy("size")
    carried = F.sum(F.col("m") * (F.col("rate") - F.col("base"))).over(up.rowsBetween(W.unboundedPreceding, W.currentRow))
    rated = rated.withColumn("upto", F.round(carried, 6)).withColumn("upto", F.floor(F.col("upto") + 0.5).cast("long"))
    rated = rated.withColumn("extra", F.greatest(F.least(F.col("upto") - F.coalesce(F.lag("upto").over(up), F.lit(0)), F.col("m")), F.lit(0)))
    # What the words taken still miss (less than the longest size) is made up by the smallest documents, until less than one of their sizes is left.
    rated = rated.withColumn("c", F.col("base") * F.col("m") + F.col("extra"))
    rated = rated.withColumn("miss", F.col("target") - F.sum(F.col("size") * F.col("c")).over(W.partitionBy("source")))
    rated = rated.withColumn("free", F.when((F.col("size") == 0) | (F.col("rate") == 0), 0).when(F.col("miss") < 0, F.col("c")).otherwise(limit * F.col("m") - F.col("c")))
    below = F.coalesce(F.sum(F.col("free") * F.col("size")).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turned = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("free"), F.floor(F.try_divide(F.abs("miss") - below, F.col("size"))).cast("long")))).otherwise(0)
    rated = rated.withColumn("c", F.col("c") + F.when(F.col("miss") > 0, turned).otherwise(-turned))
    rated = rated.withColumn("base", F.floor(F.col("c") / F.col("m")).cast("long")).withColumn("extra", F.col("c") - F.col("base") * F.col("m")).drop("upto", "c", "miss", "free")
    rated = rated.withColumn("parts", F.ceil(F.sqrt("m")).cast("long"))
    # From here on beside the input's columns, whatever their names.
    rated = scratch.table(rated, "rates").withColumnsRenamed({c: f"_mix_{c}" for c in ("base", "extra", "m", "parts")})
    extra, m = F.col("_mix_extra"), F.col("_mix_m")

    key = docs.select(F.col(source).alias("source"), "size", F.col(doc_id).alias("_id"))
    parts = (
        match(key, rated.filter((extra > 0) & (extra < m)), ["source", "size"])
        .groupBy("source", "size", "_mix_extra", "_mix_m", F.pmod(F.xxhash64("_id"), F.col("_mix_parts")).alias("part")).agg(F.count("*").alias("n"))
    )
    # A cell's extra copies are dealt to its parts in proportion.
    along = W.partitionBy("source", "size").orderBy("part")
    upto = F.floor(extra * F.sum("n").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)) / m + 1e-9)
    before = F.floor(extra * (F.sum("n").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")) / m + 1e-9)
    parts = scratch.table(parts.select("source", "size", "part", (upto - before).cast("long").alias("_mix_part_extra")), "parts")

    joined = match(docs, rated, {source: "source", "size": "size"}).withColumn("_mix_part", F.pmod(F.xxhash64(doc_id), F.col("_mix_parts")))
    joined = match(joined, parts, {source: "source", "size": "size", "_mix_part": "part"}, "left")
    place = F.row_number().over(W.partitionBy(source, "size", "_mix_part").orderBy(doc_id, F.xxhash64(text)))
    more = F.when(extra >= m, 1).when(extra <= 0, 0).otherwise((F.col("_mix_place") <= F.coalesce("_mix_part_extra", F.lit(0))).cast("int"))
    return (
        joined.withColumn("_mix_place", place)
        .withColumn("copies", (F.col("_mix_base") + more).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_mix_base", "_mix_extra", "_mix_m", "_mix_parts", "_mix_part_extra", "_mix_part", "_mix_place")
    )

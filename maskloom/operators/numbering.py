"""Placeholder numbers across the calls of a session.

The sequential loop (each call continues where the last one stopped) equals one
ranking of a session's distinct values by where they were first met.  A session
may hold a large share of all rows, so the ranking has two levels: values are
ranked inside chunks of calls, and a chunk starts at the count of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskloom.functions.numbering import values_in
from maskloom.session import join_hashed
from maskloom.sources.corpus import CALL_KEY, SESSION

CHUNK_CALLS = 4096
VALUE_GROUP = [*SESSION, "epoch", "entity_type"]
MAPPING_COLUMNS = [
    *SESSION, "epoch", "entity_type", "idx", "placeholder_key", "value",
    "first_seq", "first_ts", "saved_ts",
]


def distinct_values(spans: str = "spans", order: str = "right_to_left") -> Column:
    """``found``: the distinct values of a call as strings, as they are numbered: from the last back, unless ``left_to_right``."""
    return F.expr(values_in(spans, order)).alias("found")


def values_of(keyed: DataFrame) -> DataFrame:
    """One row per distinct value of a call, with its ``place`` in that call.

    ``keyed`` holds ``row``, call keys, ``ts``, ``epoch`` and ``found`` (see :func:`distinct_values`).  No shuffle.
    """
    rows = keyed.select("row", *CALL_KEY, "ts", "epoch", F.posexplode("found").alias("place", "k"))
    return rows.select(
        "*", F.substring_index("k", "\n", 1).alias("entity_type"),
        F.expr("substring(k, locate('\\n', k) + 1)").alias("value")).drop("k")


def first_met(values: DataFrame) -> DataFrame:
    """One row per distinct value of a session, with the call and place that met it first.

    All three minima are numbers, so this is a hash aggregate that combines
    repeats before the shuffle.
    """
    return values.groupBy(*VALUE_GROUP, "value").agg(
        F.min("call_seq").alias("first_seq"), F.min_by("place", "call_seq").alias("place"),
        F.min("ts").alias("first_ts"))


def ranked(values: DataFrame, chunk_calls: int = CHUNK_CALLS) -> DataFrame:
    """Add ``rank`` (from 0) inside each group, in order of ``first_seq, place``."""
    part = [*VALUE_GROUP, "chunk"]
    chunked = values.withColumn("chunk", F.expr(f"first_seq div {chunk_calls}L")).withColumn("__key", F.xxhash64(*part))
    before = W.partitionBy(*VALUE_GROUP).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    # Most groups lie in one chunk; only what follows another is joined.
    bases = (
        chunked.groupBy("__key", *part).agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(before)).drop("n").where("base > 0")
    )
    inside = W.partitionBy("__key", *part).orderBy("first_seq", "place")
    return (
        chunked.withColumn("in_chunk", F.row_number().over(inside) - 1)
        .join(bases.hint("merge"), ["__key", *part], "left")
        .withColumn("rank", (F.coalesce("base", F.lit(0)) + F.col("in_chunk")).cast("int"))
        .drop("__key", "chunk", "base", "in_chunk")
    )


def placeholder_key(entity: Column, idx: Column) -> Column:
    return F.concat(entity, F.lit("_"), idx.cast("string"))


def number_values(values: DataFrame, old: DataFrame | None = None,
                  chunk_calls: int = CHUNK_CALLS) -> DataFrame:
    """``idx`` for every value of ``values`` (see :func:`first_met`).

    Values already in ``old`` keep their number and, as ``saved_before``, their save
    time; new ones, marked ``fresh``, follow on.
    """
    never = [F.lit(None).cast("timestamp").alias("saved_before"), F.lit(True).alias("fresh")]
    if old is None:
        return ranked(values, chunk_calls).withColumnRenamed("rank", "idx").drop("place").select("*", *never)
    known = old.select(*VALUE_GROUP, "value", F.col("idx").alias("old_idx"))
    fresh = join_hashed(values, known, [*VALUE_GROUP, "value"], "left_anti")
    counts = old.groupBy(*VALUE_GROUP).agg(F.count("*").cast("int").alias("held"))
    new = (
        ranked(fresh, chunk_calls).join(counts, VALUE_GROUP, "left")
        .withColumn("idx", F.coalesce("held", F.lit(0)) + F.col("rank"))
        .select(*VALUE_GROUP, "value", "first_seq", "first_ts", "idx", *never)
    )
    kept = old.select(*VALUE_GROUP, "value", "first_seq", "first_ts", "idx", F.col("saved_ts").alias("saved_before"),
                      F.lit(False).alias("fresh"))
    return new.unionByName(kept)


def as_mapping(numbered: DataFrame, ends: DataFrame) -> DataFrame:
    """Numbered values as the mapping table.

    ``ends`` gives the last save of the epochs in this run; others keep theirs.
    """
    return (
        join_hashed(numbered, ends, [*SESSION, "epoch"], "left")
        .withColumn("saved_ts", F.greatest("saved_ts", "saved_before"))
        .withColumn("placeholder_key", placeholder_key(F.col("entity_type"), F.col("idx")))
        .select(*MAPPING_COLUMNS)
    )

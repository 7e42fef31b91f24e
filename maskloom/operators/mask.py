"""Masking: personal data out, placeholders in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.numbering import cut_text, entries, filled, mapping_of, rewritten
from maskloom.functions.rulebook import DEFAULT_TTL_SECONDS
from maskloom.operators.detect import detect
from maskloom.operators.numbering import (
    MAPPING_COLUMNS,
    VALUE_GROUP,
    as_mapping,
    distinct_values,
    first_met,
    number_values,
    values_of,
)
from maskloom.operators.sessions import epoch_ends, session_ticks, with_epoch
from maskloom.session import cut_lineage, join_hashed
from maskloom.sources.corpus import CALL_KEY, with_session_ids


@dataclass(frozen=True)
class Masked:
    """Masked texts, and apart from them the mapping that undoes it."""

    texts: DataFrame
    mapping: DataFrame


def _lean(detection: dict) -> dict:
    """Masking shows no scores, so they are worked out only where spans overlap."""
    return {"context": "overlaps", **detection}


def mask_texts(df: DataFrame, text_col: str = "text", order: str = "right_to_left",
               spans: str | None = None, **detection) -> DataFrame:
    """Stateless masking: every text stands alone.  No shuffle, nothing stored.

    Adds ``masked_text`` and ``mapping`` (NULL when nothing was found).  Also
    runs on a stream.  ``spans`` names a finished span column.
    """
    found = df if spans else detect(df, text_col, "__spans", **_lean(detection))
    column = spans or "__spans"
    numbered = found.select("*", F.inline(F.array(F.struct(F.expr(entries(column, order)).alias("__found")))))
    out = numbered.select(
        "*",
        F.expr(rewritten(f"`{text_col}`", column, "__found")).alias("masked_text"),
        F.expr(mapping_of("__found")).alias("mapping"),
    )
    return out.drop("__found", "__spans")


def place_numbers(hits: DataFrame, values: DataFrame, numbered: DataFrame, order: str = "right_to_left") -> DataFrame:
    """Each call's spans replaced by the numbers its session gave them.

    Only calls with spans get here, told apart by ``row``.  Their values (see ``values_of``; no text)
    meet the numbers on the full value key, then come back to their own row as placeholders by place; no
    session is ever gathered as a whole.  A text is cut at its spans before it moves.
    """
    known = numbered.select(*VALUE_GROUP, "value", "idx")
    placeholder = F.concat(F.lit("{{"), "entity_type", F.lit("_"), F.col("idx").cast("string"), F.lit("}}"))
    met = join_hashed(values.select("row", "place", *VALUE_GROUP, "value"), known, [*VALUE_GROUP, "value"])
    # Dealt out first: no row has two values in one task before, so adding up there would be in vain.
    per_row = (
        met.select("row", F.struct("place", placeholder.alias("mark")).alias("seat")).repartition("row")
        .groupBy("row").agg(F.sort_array(F.collect_list("seat")).alias("marks"))
    )
    ready = hits.select("*", F.expr(cut_text("text", "spans", order)).alias("cut")).drop("text", "spans")
    return ready.join(per_row.hint("merge"), "row").withColumn("masked_text", F.expr(filled("cut", "marks"))).drop("cut", "marks", "row")


def mask_sessions(calls: DataFrame, ttl: int = DEFAULT_TTL_SECONDS, old: DataFrame | None = None,
                  order: str = "right_to_left", spans: str | None = None, history: DataFrame | None = None,
                  added_only: bool = False, **detection) -> Masked:
    """Stateful masking: one numbering per session, until it expires.

    ``old`` is a stored mapping to continue, ``history`` the last saves of its sessions
    where ``old`` doesn't tell (see `MappingStore.epochs`); ``spans`` names a finished span column,
    such as `detect_with_model` makes.  With ``added_only`` the mapping holds what these calls
    add to ``old`` and, without a placeholder, the sessions they save again.  Detected calls are written once to
    the checkpoint folder: numbering, rewriting and the untouched calls all read
    them, and writing costs far less than detecting again.  So is every table between that more than
    one step reads: session times, the values of each call, those of each session, and the numbers.  A text is shuffled at most once, to meet its own
    call's placeholders; calls without personal data are not shuffled at all.
    """
    calls = with_session_ids(calls)
    ready = calls.withColumn("spans", F.col(spans)) if spans else detect(calls, **_lean(detection))
    found = cut_lineage(ready.select(F.monotonically_increasing_id().alias("row"), *CALL_KEY, "ts", "text", "spans"))
    ticks = cut_lineage(session_ticks(found, ttl, old if history is None else history))
    hits = found.filter(F.size("spans") > 0)
    keyed = with_epoch(hits.select("row", *CALL_KEY, "ts", distinct_values("spans", order)), ticks, ttl)
    values = cut_lineage(values_of(keyed))
    numbered = cut_lineage(number_values(cut_lineage(first_met(values)), old))
    masked = place_numbers(hits, values, numbered, order).select(*CALL_KEY, "ts", "masked_text")
    clean = found.filter(F.size("spans") == 0).select(
        *CALL_KEY, "ts", F.col("text").alias("masked_text"))
    ends = epoch_ends(ticks)
    mapping = as_mapping(numbered.where("fresh") if added_only else numbered, ends)
    if added_only:
        mapping = mapping.unionByName(ends, allowMissingColumns=True)
    return Masked(masked.unionByName(clean), mapping.select(*MAPPING_COLUMNS))


def mask_calls(calls: DataFrame, ttl: int = DEFAULT_TTL_SECONDS, store: bool = True,
               old: DataFrame | None = None, **detection) -> Masked:
    """Calls of both modes.  Stateless ones lose their session and keep their mapping.

    Options go to `mask_texts` and `mask_sessions`, ``spans`` among them.
    With ``store=False`` there is nowhere to keep a mapping, and a stateful call
    is an error.
    """
    def alone(rows: DataFrame) -> DataFrame:
        return mask_texts(rows, **detection).select(
            "system_id", F.lit(None).cast("string").alias("session_id"), "call_seq", "ts",
            "masked_text", "mapping")

    is_stateless = F.col("mode") == "stateless"
    if not store:
        check = F.assert_true(is_stateless, "stateful mode needs a mapping store")
        empty = calls.sparkSession.createDataFrame([], ", ".join(_EMPTY_MAPPING))
        return Masked(alone(calls.filter(check.isNull())), empty)
    kept = mask_sessions(calls.filter(~is_stateless), ttl, old, **detection)
    texts = kept.texts.withColumn("mapping", F.lit(None).cast("map<string,string>"))
    return Masked(alone(calls.filter(is_stateless)).unionByName(texts), kept.mapping)


_EMPTY_MAPPING = [
    "system_id string", "session_id string", "epoch int", "entity_type string", "idx int",
    "placeholder_key string", "value string", "first_seq bigint", "first_ts timestamp",
    "saved_ts timestamp",
]

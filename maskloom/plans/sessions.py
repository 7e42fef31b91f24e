"""Numbering, masking, the mapping table, restoring, tenancy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.numbering import entries
from maskloom.functions.rulebook import DEFAULT_TTL_SECONDS
from maskloom.operators.detect import detect
from maskloom.operators.mapping import forget_sessions, load_mapping, merge_mapping, purge_expired
from maskloom.operators.mask import mask_calls, mask_sessions, mask_texts
from maskloom.operators.names import detect_with_model
from maskloom.operators.restore import (
    placeholder_rows,
    restore_as_of,
    restore_own,
    restore_sessions,
    unresolved,
)
from maskloom.operators.sessions import session_ticks, with_epoch
from maskloom.operators.store import MappingStore
from maskloom.operators.tenancy import parse_tenants, resolve_callers, split_rejects
from maskloom.plans.detection import CARD_RES, EMAIL_RE, IP_RE, LUHN_SUM
from maskloom.plans.fixtures import (
    CALLS_CTE,
    OCCURRENCES_CTE,
    built_texts,
    call_table,
    masked_text_sql,
    select_df,
    select_sql,
    table,
    text_of,
    texts,
)
from maskloom.session import cut_lineage, shared_dir
from maskloom.sources.corpus import CALL_KEY, as_calls, write_masked

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TTL = DEFAULT_TTL_SECONDS


def _calls(spark: SparkSession, sf_dir: str, mode: str = "'stateful'") -> DataFrame:
    return as_calls(call_table(spark, sf_dir), system="system_id", session="session_id",
                    order="call_seq", ts="ts", mode=F.expr(mode))


# --- the same in SQL ----------------------------------------------------------
# Epochs by comparing each call with the one before; numbers by one ranking per
# session.  Neither uses the buckets or chunks of the Spark plans.

def _epoch_cte(ttl: int) -> str:
    return (
        "ep AS (SELECT system_id, session_id, call_seq, cast(sum(fresh) OVER (PARTITION BY system_id, session_id "
        "ORDER BY call_seq) as int) AS epoch FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER "
        f"(PARTITION BY system_id, session_id ORDER BY call_seq)) >= {ttl * 1_000_000} THEN 1 ELSE 0 END AS fresh FROM calls))"
    )


_EPOCH_CTE = _epoch_cte(TTL)
_MAP_CTE = (
    "num AS (SELECT system_id, session_id, epoch, entity_type, value, min(call_seq) AS first_seq, min(ts) AS first_ts, "
    "cast(row_number() OVER (PARTITION BY system_id, session_id, epoch, entity_type "
    "ORDER BY min(call_seq * 10 - pos)) - 1 as int) AS idx FROM occ JOIN ep USING (system_id, session_id, call_seq) "
    "GROUP BY system_id, session_id, epoch, entity_type, value), "
    "ends AS (SELECT system_id, session_id, epoch, max(ts) AS saved_ts FROM calls JOIN ep USING "
    "(system_id, session_id, call_seq) GROUP BY ALL), "
    "mapping AS (SELECT *, entity_type || '_' || cast(idx as string) AS placeholder_key FROM num JOIN ends "
    "USING (system_id, session_id, epoch))"
)
_ALL_CTES = f"WITH {CALLS_CTE}, {OCCURRENCES_CTE}, {_EPOCH_CTE}, {_MAP_CTE}"


def _keyed_calls(columns: str) -> str:
    """Calls joined with the placeholder of each of their values."""
    joins = " ".join(
        f"LEFT JOIN mapping m{i} ON m{i}.system_id = c.system_id AND m{i}.session_id = c.session_id AND "
        f"m{i}.epoch = e.epoch AND m{i}.entity_type = '{t}' AND m{i}.value = c.{v}"
        for i, (t, v) in enumerate((("PHONE_NUMBER", "phone"), ("EMAIL", "mail_a"), ("EMAIL", "mail_b"), ("IP_ADDRESS", "ip"))))
    return (
        f"SELECT {columns} FROM (SELECT c.*, e.epoch, "
        + ", ".join(f"coalesce('{{{{' || m{i}.placeholder_key || '}}}}', '') AS p{i}" for i in range(4))
        + f" FROM calls c JOIN ep e USING (system_id, session_id, call_seq) {joins})"
    )


_MASKED = masked_text_sql({"phone": "p0", "mail_a": "p1", "mail_b": "p2", "ip": "p3"})
_MASKED_SQL = f"{_ALL_CTES} " + _keyed_calls(f"system_id, session_id, call_seq, {_MASKED} AS masked_text")

# Numbers inside one call: both addresses of a call are EMAIL, the last one is 0.
_OWN = masked_text_sql({
    "phone": "'{{PHONE_NUMBER_0}}'", "mail_a": "'{{EMAIL_1}}'", "mail_b": "'{{EMAIL_0}}'", "ip": "'{{IP_ADDRESS_0}}'",
})
_OWN_LEFT = masked_text_sql({
    "phone": "'{{PHONE_NUMBER_0}}'", "mail_a": "'{{EMAIL_0}}'", "mail_b": "'{{EMAIL_1}}'", "ip": "'{{IP_ADDRESS_0}}'",
})


# --- numbering ----------------------------------------------------------------

def m1_numbering_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_calls(spark, sf_dir))
    rows = found.select("call_seq", F.inline(F.expr(entries("spans"))))
    return rows.select("call_seq", "entity_type", "idx", "placeholder_key", "value")


def m2_left_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_texts(_calls(spark, sf_dir), order="left_to_right").select("call_seq", "masked_text")


def m3_session_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_sessions(_calls(spark, sf_dir)).mapping.select(
        "system_id", "session_id", "epoch", "entity_type", "idx", "placeholder_key", "value", "first_seq")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The calls of the first days, and the later ones."""
    calls = _calls(spark, sf_dir)
    cut = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return calls.filter(F.col("ts") < cut), calls.filter(F.col("ts") >= cut)


def m4_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking the later calls on a stored mapping ends as one run would."""
    early, late = _halves(spark, sf_dir)
    stored = cut_lineage(mask_sessions(early).mapping)
    grown = mask_sessions(late, old=stored).mapping
    return grown.select("system_id", "session_id", "entity_type", "idx", "value", "first_seq", "saved_ts")


def m5_rewrite_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_sessions(_calls(spark, sf_dir)).texts.select(*CALL_KEY, "masked_text")


def m5_model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in which a model's names are masked with everything else."""
    spans = call_table(spark, sf_dir).filter("has_pii").selectExpr(
        "call_seq", "0 AS start", "5 + length(kind) AS end", "'en' AS lang")
    found = detect_with_model(_calls(spark, sf_dir), spans, "call_seq")
    return mask_sessions(found, spans="spans").texts.select(*CALL_KEY, "masked_text")


def m6_mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_texts(_calls(spark, sf_dir))
    return masked.select("call_seq", F.explode_outer("mapping").alias("placeholder_key", "value"))


_MODE = "CASE WHEN call_seq % 3 = 0 THEN 'stateless' WHEN call_seq % 3 = 1 THEN 'Stateless' ELSE 'stateful' END"
_OWN_SESSION = "left(sha256(concat_ws('|', system_id, {seq}, cast(epoch_us(ts) as string), text)), 32)"
_MODE_SESSION = "CASE WHEN call_seq % 7 <> 2 THEN session_id END"


def m7_m8_both_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes together; some calls come without a session."""
    calls = _calls(spark, sf_dir, _MODE).withColumn("session_id", F.expr(_MODE_SESSION))
    return mask_calls(calls).texts.select(
        "system_id", "call_seq", F.col("session_id").isNull().alias("no_session"),
        F.coalesce(F.size("mapping"), F.lit(0)).alias("n_mapping"), "masked_text")


def m8_own_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateful call without a session gets one of its own."""
    calls = _calls(spark, sf_dir).withColumn("session_id", F.lit(None).cast("string"))
    return mask_sessions(calls).texts.select("system_id", "call_seq", "session_id", "masked_text")


def m8_repeated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without a session that share their numbers still have a session each."""
    calls = _calls(spark, sf_dir).withColumns({"session_id": F.lit(None).cast("string"), "call_seq": F.col("call_seq") % 5})
    return mask_sessions(calls).texts.select("system_id", "call_seq", "session_id", "masked_text")


def m9_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    return with_epoch(calls, session_ticks(calls)).select(*CALL_KEY, "epoch")


def m10_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_texts(_calls(spark, sf_dir))
    return masked.filter(F.col("text") == F.col("masked_text")).select("call_seq", "masked_text")


_STATELESS_SQL = f"WITH {CALLS_CTE} SELECT call_seq, {{0}} AS masked_text FROM calls"
QUERIES |= {
    "m1_numbering_in_text": m1_numbering_in_text, "m2_left_to_right": m2_left_to_right,
    "m3_session_numbering": m3_session_numbering, "m4_incremental": m4_incremental,
    "m5_rewrite_sessions": m5_rewrite_sessions, "m5_model_names": m5_model_names, "m6_mapping_rows": m6_mapping_rows,
    "m7_m8_both_modes": m7_m8_both_modes, "m8_own_session": m8_own_session, "m8_repeated_numbers": m8_repeated_numbers,
    "m9_epochs": m9_epochs, "m10_unchanged": m10_unchanged,
}
_OWN_ROWS = (
    f"WITH {CALLS_CTE}, {OCCURRENCES_CTE}, own AS (SELECT call_seq, entity_type, value, cast(row_number() OVER "
    "(PARTITION BY call_seq, entity_type ORDER BY pos DESC) - 1 as int) AS idx FROM occ)"
)
_NAMED = (
    f"WITH {CALLS_CTE}, "
    + OCCURRENCES_CTE.replace("occ AS (", "occ AS (SELECT system_id, session_id, call_seq, ts, 'PERSON' AS entity_type, "
                              "'Case ' || kind AS value, 0 AS pos FROM calls WHERE has_pii UNION ALL ", 1)
    + f", {_EPOCH_CTE}, {_MAP_CTE}"
)
ORACLES |= {
    "m5_model_names": f"{_NAMED}, k AS ({_keyed_calls(f'system_id, session_id, call_seq, epoch, kind, has_pii, {_MASKED} AS t')}) "
                      "SELECT k.system_id, k.session_id, call_seq, CASE WHEN has_pii THEN replace(t, 'Case ' || kind || ':', "
                      "'{{' || m.placeholder_key || '}}:') ELSE t END AS masked_text FROM k LEFT JOIN mapping m ON m.system_id = k.system_id "
                      "AND m.session_id = k.session_id AND m.epoch = k.epoch AND m.entity_type = 'PERSON' AND m.value = 'Case ' || kind",
    "m1_numbering_in_text": f"{_OWN_ROWS} SELECT call_seq, entity_type, idx, entity_type || '_' || cast(idx as string) "
                            "AS placeholder_key, value FROM own",
    "m2_left_to_right": _STATELESS_SQL.format(_OWN_LEFT),
    "m3_session_numbering": f"{_ALL_CTES} SELECT system_id, session_id, epoch, entity_type, idx, placeholder_key, value, first_seq FROM mapping",
    "m5_rewrite_sessions": _MASKED_SQL,
    "m6_mapping_rows": f"{_OWN_ROWS} SELECT call_seq, entity_type || '_' || cast(idx as string) AS placeholder_key, value "
                       "FROM calls LEFT JOIN own USING (call_seq)",
    "m9_epochs": f"WITH {CALLS_CTE}, {_EPOCH_CTE} SELECT * FROM ep",
    "m10_unchanged": f"WITH {CALLS_CTE} SELECT call_seq, text AS masked_text FROM calls WHERE NOT has_pii",
    # As one run over all calls numbers it.  Epoch numbers may differ: the stored
    # mapping does not remember epochs in which nothing was found.
    "m4_incremental": f"{_ALL_CTES} SELECT system_id, session_id, entity_type, idx, value, first_seq, saved_ts FROM mapping",
    "m8_own_session": f"WITH {CALLS_CTE} SELECT system_id, call_seq, {_OWN_SESSION.format(seq='cast(call_seq as string)')} "
                      f"AS session_id, {_OWN} AS masked_text FROM calls",
    "m8_repeated_numbers": f"WITH {CALLS_CTE} SELECT system_id, call_seq % 5 AS call_seq, "
                           f"{_OWN_SESSION.format(seq='cast(call_seq % 5 as string)')} AS session_id, {_OWN} AS masked_text FROM calls",
}
# Stateful rows of the mixed run: numbering over the stateful calls alone.
_MIXED_CALLS = (
    f"{CALLS_CTE.replace('calls AS', 'every_call AS', 1)}, "
    f"calls AS (SELECT * REPLACE (coalesce({_MODE_SESSION}, {_OWN_SESSION.format(seq='cast(call_seq as string)')}) AS session_id) "
    f"FROM every_call WHERE ({_MODE}) <> 'stateless')"
)
ORACLES["m7_m8_both_modes"] = (
    f"WITH {_MIXED_CALLS}, {OCCURRENCES_CTE}, {_EPOCH_CTE}, {_MAP_CTE} "
    + _keyed_calls(f"system_id, call_seq, false AS no_session, cast(0 as int) AS n_mapping, {_MASKED} AS masked_text")
    + f" UNION ALL SELECT system_id, call_seq, true, cast(CASE WHEN has_pii THEN 3 + cast(has_ip as int) ELSE 0 END as int), {_OWN} "
    f"FROM every_call WHERE ({_MODE}) = 'stateless'"
)


def real_conversations_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of real turns: masked, restored, and compared with the source."""
    turns = as_calls(texts(spark, sf_dir, "conversations"), system=F.lit("chat"),
                     session=F.col("conv_id").cast("string"), order="turn",
                     ts=F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(turn as int), 0)"))
    done = mask_sessions(turns)
    back = restore_sessions(done.texts.withColumnRenamed("masked_text", "reply"), done.mapping, CALL_KEY, "reply")
    joined = back.join(turns.select(*CALL_KEY, F.col("text").alias("source")), CALL_KEY)
    return joined.groupBy("system_id").agg(
        F.count("*").alias("turns"), F.sum((F.col("source") == F.col("restored_text")).cast("long")).alias("restored"))


QUERIES["rs8_conversations_round_trip"] = real_conversations_masked
ORACLES["rs8_conversations_round_trip"] = (
    "SELECT 'chat' AS system_id, count(*) AS turns, cast(count(*) as bigint) AS restored FROM conversations"
)

# --- the flagship: stateless masking of the documents --------------------------


def documents_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    masked = mask_texts(docs)
    return masked.select(
        "doc_id", "masked_text", F.coalesce(F.size("mapping"), F.lit(0)).alias("n_values"))


_SQL_TYPES = ["EMAIL", "IP_ADDRESS", "CREDIT_CARD"]


def documents_masked_sql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked documents for the types whose rules can be said in the other engine's SQL."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    masked = mask_texts(docs, entities=_SQL_TYPES, merge_blanks=False)
    return masked.select(
        "doc_id", F.sha2("masked_text", 256).alias("text_hash"),
        F.coalesce(F.size("mapping"), F.lit(0)).alias("n_values"))


def documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    back = restore_own(mask_texts(docs))
    return back.select("doc_id", F.sha2("restored_text", 256).alias("text_hash"))


QUERIES["m0_documents_masked_sql_types"] = documents_masked_sql_types
# A card swallows one separator where no letter or digit follows, so its right
# edge is read with the next character, outside the group.
_CARD_EDGE_RES = [p.removesuffix(r"\b") + ")(?:[^A-Za-z0-9]|$)" for p in (r.replace(r"\b", r"\b(", 1) for r in CARD_RES)]
_VALUE_LISTS = " UNION ALL ".join(
    f"SELECT doc_id, text, '{entity}' AS t, regexp_extract_all(text, '{pattern}', {group}) AS vs FROM documents"
    for entity, pattern, group in [
        ("EMAIL", EMAIL_RE, 0), ("IP_ADDRESS", IP_RE, 0), *[("CREDIT_CARD", p, 1) for p in _CARD_EDGE_RES]])
ORACLES["m0_documents_masked_sql_types"] = (
    f"WITH lists AS ({_VALUE_LISTS}), "
    "hit AS (SELECT doc_id, text, t, unnest(vs) AS v FROM lists), "
    "ok AS (SELECT DISTINCT doc_id, t, v, strpos(reverse(text), reverse(v)) AS from_end FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM hit) "
    f"WHERE t <> 'CREDIT_CARD' OR {LUHN_SUM} % 10 = 0), "
    "num AS (SELECT doc_id, v, '{{' || t || '_' || cast(row_number() OVER (PARTITION BY doc_id, t ORDER BY from_end) - 1 as string) || '}}' AS p FROM ok), "
    "pairs AS (SELECT doc_id, list([v, p] ORDER BY length(v) DESC, v) AS ps FROM num GROUP BY doc_id) "
    "SELECT doc_id, sha256(CASE WHEN ps IS NULL THEN text ELSE list_reduce(list_prepend([text], ps), lambda a, x: [regexp_replace(a[1], regexp_escape(x[1]) || '([^A-Za-z0-9]|$)', x[2] || '\\1', 'g')])[1] END) AS text_hash, "
    "cast(coalesce(len(ps), 0) as int) AS n_values FROM documents LEFT JOIN pairs USING (doc_id)"
)
QUERIES["m0_documents_masked"] = documents_masked
QUERIES["rs6_documents_round_trip"] = documents_round_trip
ORACLES["rs6_documents_round_trip"] = "SELECT doc_id, sha256(text) AS text_hash FROM documents"

# --- mapping table ------------------------------------------------------------

_AT = "2024-01-15 12:00:00"
#: Long enough for a few of the epochs of a session to be alive at once.
_LONG_TTL = 40 * 3600


def src2_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store would still hold of the early calls' mappings at one moment."""
    early = _calls(spark, sf_dir).filter(F.col("ts") <= F.lit(_AT).cast("timestamp"))
    alive = load_mapping(mask_sessions(early).mapping, _AT)
    return alive.select("system_id", "session_id", "placeholder_key", "value")


def _two_saves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two saves per session; the later one overwrites some keys and adds others."""
    calls = call_table(spark, sf_dir).filter("has_pii")

    def save(when: str, value: str) -> DataFrame:
        return calls.filter(when).selectExpr(
            "system_id", "session_id", "0 AS epoch", "'PHONE_NUMBER_' || cast(call_seq % 5 as string) AS placeholder_key",
            f"{value} AS value", "ts").groupBy("system_id", "session_id", "epoch", "placeholder_key").agg(
            F.max_by("value", "ts").alias("value"), F.max("ts").alias("saved_ts"))

    return save("call_seq % 2 = 0", "phone"), save("call_seq % 2 = 1", "mail_a")


def snk1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_mapping(*_two_saves(spark, sf_dir))
    return merged.select("system_id", "session_id", "placeholder_key", "value", "saved_ts")


def saved_in_turns(spark: SparkSession, sf_dir: str, path: str) -> MappingStore:
    """The mapping of all calls, saved in four turns as the calls came; the first three are merged by the fourth."""
    store = MappingStore(spark, path, buckets=16, fanout=3)
    mapping = cut_lineage(mask_sessions(_calls(spark, sf_dir)).mapping)
    turn = F.ceil(F.dayofyear("first_ts") / 8)
    for n in range(1, 5):
        store.save(mapping.where(turn == n if n < 4 else turn >= n), "turns", n)
        store.compact()
    return store


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def src2_store_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds of three sessions at one moment, looked up by key."""
    store = saved_in_turns(spark, sf_dir, _folder(spark))
    some = [(f"sys_{u % 3}", f"u{u}") for u in (1, 5, 7)]
    return store.load(some, _AT, ttl=_LONG_TTL).select("system_id", "session_id", "epoch", "placeholder_key", "value")


def snk1_store_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saves of the same keys in a store: as its levels add up, and merged into one."""
    store = MappingStore(spark, _folder(spark), buckets=16)
    for n, saved in enumerate(_two_saves(spark, sf_dir)):
        full = saved.selectExpr("*", "'PHONE_NUMBER' AS entity_type", "0 AS idx", "0L AS first_seq", "saved_ts AS first_ts")
        store.save(full, "saves", n)
        store.save(full, "saves", n)
    before = store.read()
    store.rewrite()
    after = store.read()
    columns = ["system_id", "session_id", "placeholder_key", "value", "saved_ts"]
    return before.select(F.lit("levels").alias("state"), *columns).unionByName(
        after.select(F.lit("merged").alias("state"), *columns))


def snk2_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _two_saves(spark, sf_dir)[0]
    gone = call_table(spark, sf_dir).filter("kind = 'error'").groupBy("system_id", "session_id").agg(
        F.count("*").alias("errors")).filter("errors % 2 = 0")
    return forget_sessions(mapping, gone).select("system_id", "session_id", "placeholder_key", "value")


def snk3_write_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts and mapping as their folders hold them."""
    done = mask_sessions(_calls(spark, sf_dir))
    place = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    write_masked(done.texts, done.mapping, f"{place}/texts", f"{place}/mapping")
    texts = spark.read.parquet(f"{place}/texts").selectExpr("'text' AS part", "system_id", "session_id", "masked_text AS content")
    return texts.unionByName(spark.read.parquet(f"{place}/mapping").selectExpr(
        "'mapping' AS part", "system_id", "session_id", "placeholder_key || '=' || value AS content"))


def snk3_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = purge_expired(mask_sessions(_calls(spark, sf_dir)).mapping, _AT)
    return mapping.select("system_id", "session_id", "epoch", "placeholder_key", "value")


def _save_sql(parity: int, value: str) -> str:
    return (
        "SELECT system_id, session_id, 'PHONE_NUMBER_' || cast(call_seq % 5 as string) AS placeholder_key, "
        f"max_by({value}, ts) AS value, max(ts) AS saved_ts FROM calls WHERE has_pii AND call_seq % 2 = {parity} "
        "GROUP BY system_id, session_id, placeholder_key"
    )


QUERIES |= {"src2_load": src2_load, "snk1_merge": snk1_merge, "snk2_forget": snk2_forget,
            "snk3_write_masked": snk3_write_masked, "snk3_purge": snk3_purge}
ORACLES |= {
    "src2_load": _ALL_CTES.replace("calls AS (", "calls AS (SELECT * FROM (", 1).replace(
        "FROM events))", f"FROM events)) WHERE ts <= timestamp '{_AT}')", 1)
        + f" SELECT system_id, session_id, placeholder_key, value FROM mapping WHERE saved_ts > timestamp '{_AT}' - interval {TTL} second",
    "snk2_forget": f"WITH {CALLS_CTE}, gone AS (SELECT system_id, session_id FROM calls WHERE kind = 'error' "
                   f"GROUP BY system_id, session_id HAVING count(*) % 2 = 0) SELECT system_id, session_id, placeholder_key, value FROM ({_save_sql(0, 'phone')}) a "
                   "WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.system_id = a.system_id AND g.session_id = a.session_id)",
}
ORACLES |= {
    "snk3_write_masked": f"{_ALL_CTES}, t AS ({_keyed_calls(f'system_id, session_id, {_MASKED} AS content')}) "
                         "SELECT 'text' AS part, system_id, session_id, content FROM t UNION ALL "
                         "SELECT 'mapping', system_id, session_id, placeholder_key || '=' || value FROM mapping",
    "snk3_purge": f"{_ALL_CTES} SELECT system_id, session_id, epoch, placeholder_key, value FROM mapping "
                  f"WHERE saved_ts > timestamp '{_AT}' - interval {TTL} second",
}
QUERIES |= {"src2_store_load": src2_store_load, "snk1_store_levels": snk1_store_levels}
ORACLES["src2_store_load"] = (
    f"{_ALL_CTES} SELECT system_id, session_id, epoch, placeholder_key, value FROM mapping WHERE first_ts <= timestamp '{_AT}' "
    f"AND saved_ts > timestamp '{_AT}' - interval {_LONG_TTL} second AND session_id IN ('u1', 'u5', 'u7')"
)
# max() over the window must see both saves, so it is taken before the ranking.
ORACLES["snk1_merge"] = (
    f"WITH {CALLS_CTE}, a AS ({_save_sql(0, 'phone')}), b AS ({_save_sql(1, 'mail_a')}), "
    "both_saves AS (SELECT * FROM a UNION ALL SELECT * FROM b) "
    "SELECT system_id, session_id, placeholder_key, value, last_save AS saved_ts FROM ("
    "SELECT *, max(saved_ts) OVER (PARTITION BY system_id, session_id) AS last_save, row_number() OVER "
    "(PARTITION BY system_id, session_id, placeholder_key ORDER BY saved_ts DESC) AS rn FROM both_saves) WHERE rn = 1"
)

ORACLES["snk1_store_levels"] = f"SELECT s.state, m.* FROM ({ORACLES['snk1_merge']}) m, (VALUES ('levels'), ('merged')) s(state)"

# --- restore ------------------------------------------------------------------

_REPLY_COLUMNS = {
    "reply_id": "event_id", "system_id": f"'sys_' || {text_of('user_id % 3')}", "session_id": f"'u' || {text_of('user_id')}",
    "late": "(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 600 WHEN 2 THEN 3599 ELSE 3601 END)", "ts": "ts",
    "n": "event_id % 6", "kind": "event_type",
}
_REPLY_TEXT = (
    "'Noted {{PHONE_NUMBER_' || cast(n % 3 as string) || '}} and {{EMAIL_' || cast(n as string) || '}}, again "
    "{{PHONE_NUMBER_' || cast(n % 3 as string) || '}}; {{UNKNOWN_0}} {{EMAIL_00}} {x} ' || kind"
)


def _reply_text(phone: str, mail: str) -> str:
    return f"'Noted ' || {phone} || ' and ' || {mail} || ', again ' || {phone} || '; {{{{UNKNOWN_0}}}} {{{{EMAIL_00}}}} {{x}} ' || kind"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = select_df(built_texts(spark, sf_dir, "events"), _REPLY_COLUMNS)
    return built.selectExpr(
        "reply_id", "system_id", "session_id", f"{_REPLY_TEXT} AS text", "kind",
        "cast(ts + late * interval '1' second AS timestamp) AS ts")


def rs1_placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placeholder_rows(_replies(spark, sf_dir), ["reply_id"])



def rs2_restore_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known, unknown and foreign placeholders; some replies name a wrong system."""
    replies = _replies(spark, sf_dir).withColumn(
        "system_id", F.when(F.col("reply_id") % 9 == 0, "sys_other").otherwise(F.col("system_id")))
    back = restore_sessions(replies, mask_sessions(_calls(spark, sf_dir)).mapping, ["system_id", "session_id", "reply_id"])
    return back.select("reply_id", "system_id", "restored_text")


def rs5_restore_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    mapping = mask_sessions(calls).mapping
    back = restore_as_of(_replies(spark, sf_dir), mapping, session_ticks(calls), ["system_id", "session_id", "reply_id"])
    return back.select("reply_id", "restored_text")


def rs7_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = unresolved(_replies(spark, sf_dir), mask_sessions(_calls(spark, sf_dir)).mapping, ["system_id", "session_id", "reply_id"])
    return missing.select("reply_id", "placeholder_key")


def rs8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask every call in its session, restore it from the table, compare."""
    calls = _calls(spark, sf_dir)
    done = mask_sessions(calls)
    replies = done.texts.withColumnRenamed("masked_text", "reply")
    back = restore_as_of(replies, done.mapping, session_ticks(calls), CALL_KEY, text_col="reply")
    both = back.join(calls.select(*CALL_KEY, "text"), CALL_KEY)
    return both.groupBy("system_id").agg(
        F.count("*").alias("calls"), F.sum((F.col("text") == F.col("restored_text")).cast("long")).alias("same"))


_REPLIES_CTE = (
    f"replies AS (SELECT *, ts + late * interval 1 second AS reply_ts FROM ({select_sql(_REPLY_COLUMNS, 'events')}))"
)
def _filled_replies(mapping: str, system: str, extra: str = "") -> str:
    """Replies with their two known kinds of placeholder looked up."""
    def look(alias: str, key: str) -> str:
        return (
            f"LEFT JOIN {mapping} {alias} ON {alias}.system_id = {system} AND {alias}.session_id = r.session_id AND "
            f"{alias}.placeholder_key = {key} {extra.format(a=alias)}"
        )

    phone_key = "'PHONE_NUMBER_' || cast(r.n % 3 as string)"
    mail_key = "'EMAIL_' || cast(r.n as string)"
    return (
        f"SELECT r.*, coalesce(mp.value, '{{{{' || {phone_key} || '}}}}') AS got_phone, "
        f"coalesce(mm.value, '{{{{' || {mail_key} || '}}}}') AS got_mail FROM replies r {look('mp', phone_key)} {look('mm', mail_key)}"
    )


_REPLY_SYSTEM = "(CASE WHEN r.reply_id % 9 = 0 THEN 'sys_other' ELSE r.system_id END)"
def _live_cte(ttl: int) -> str:
    return (
        "live AS (SELECT reply_id, max_by(epoch, call_seq) AS epoch FROM (SELECT r.reply_id, e.epoch, c.call_seq FROM replies r "
        "JOIN calls c ON c.system_id = r.system_id AND c.session_id = r.session_id AND c.ts <= r.reply_ts "
        f"AND c.ts > r.reply_ts - interval {ttl} second JOIN ep e ON e.call_seq = c.call_seq) GROUP BY reply_id)"
    )


_LIVE_CTE = _live_cte(TTL)
# What each reply could see: the entries of its session's live epoch that were met before it.
_SEEN_CTE = (
    "seen AS (SELECT m.*, l.reply_id AS seen_by FROM mapping m JOIN replies r ON r.system_id = m.system_id AND "
    "r.session_id = m.session_id JOIN live l ON l.reply_id = r.reply_id AND l.epoch = m.epoch AND m.first_ts <= r.reply_ts)"
)
_SEEN = f"{_ALL_CTES}, {_REPLIES_CTE}, {_LIVE_CTE}, {_SEEN_CTE}"
_BY_REPLY = "AND {a}.seen_by = r.reply_id"
QUERIES |= {
    "rs1_placeholder_scan": rs1_placeholder_scan, "rs2_rs3_rs4_restore_sessions": rs2_restore_sessions,
    "rs5_restore_as_of": rs5_restore_as_of, "rs7_unresolved": rs7_unresolved, "rs8_round_trip": rs8_round_trip,
}
ORACLES |= {
    "rs1_placeholder_scan": f"WITH {_REPLIES_CTE} SELECT reply_id, unnest(['PHONE_NUMBER_' || cast(n % 3 as string), "
                            "'EMAIL_' || cast(n as string), 'UNKNOWN_0', 'EMAIL_00']) AS placeholder_key FROM replies",
    "rs2_rs3_rs4_restore_sessions": f"{_SEEN} SELECT reply_id, "
                                    "CASE WHEN reply_id % 9 = 0 THEN 'sys_other' ELSE system_id END AS system_id, "
                                    f"{_reply_text('got_phone', 'got_mail')} AS restored_text FROM ({_filled_replies('seen', _REPLY_SYSTEM, _BY_REPLY)})",
    "rs5_restore_as_of": f"{_SEEN} SELECT reply_id, {_reply_text('got_phone', 'got_mail')} AS restored_text FROM "
                         f"({_filled_replies('seen', 'r.system_id', _BY_REPLY)})",
    "rs7_unresolved": f"{_SEEN} SELECT reply_id, placeholder_key FROM (SELECT reply_id, "
                      "unnest(['PHONE_NUMBER_' || cast(n % 3 as string), 'EMAIL_' || cast(n as string), 'UNKNOWN_0', 'EMAIL_00']) AS placeholder_key "
                      "FROM replies) p WHERE NOT EXISTS (SELECT 1 FROM seen m WHERE m.seen_by = p.reply_id AND m.placeholder_key = p.placeholder_key)",
    "rs8_round_trip": f"WITH {CALLS_CTE} SELECT system_id, count(*) AS calls, cast(count(*) as bigint) AS same FROM calls GROUP BY system_id",
}

# --- tenancy ------------------------------------------------------------------

_SETTING_COLUMNS = {
    "setting_id": "c_custkey",
    "n": text_of("c_custkey"), "nation": text_of("c_nationkey"),
}
_SETTING = (
    "' sys_' || nation || ':key_' || n || ', ,no-colon,sys_x: k:' || n || ':z ,sys_late:key_' || n || "
    "CASE WHEN setting_id % 2 = 0 THEN ',:key_empty' ELSE ',' END"
)


def ten1_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = select_df(table(spark, sf_dir, "customer"), _SETTING_COLUMNS).selectExpr("setting_id", f"{_SETTING} AS raw")
    return parse_tenants(settings, "raw", ["setting_id"]).select("setting_id", "api_key", "system_id")


_CALLER_COLUMNS = {
    "call_id": "o_orderkey",
    "api_key": f"CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'unknown' ELSE 'key_' || {text_of('o_custkey % 25')} END",
}
_TENANT_COLUMNS = {"api_key": f"'key_' || {text_of('n_nationkey')}",
                   "system_id": "CASE WHEN n_nationkey = 3 THEN '' ELSE lower(n_name) END"}


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    callers = select_df(table(spark, sf_dir, "orders"), _CALLER_COLUMNS)
    tenants = select_df(table(spark, sf_dir, "nation"), _TENANT_COLUMNS)
    return resolve_callers(callers, tenants)


QUERIES |= {
    "ten1_parse": ten1_parse,
    "ten2_resolve": lambda spark, sf_dir: _resolved(spark, sf_dir).select("call_id", "system_id", "status"),
    "ten3_rejects": lambda spark, sf_dir: split_rejects(_resolved(spark, sf_dir))[1].select("call_id", "status"),
}
_RESOLVED_SQL = (
    f"SELECT call_id, system_id, CASE WHEN coalesce(api_key, '') = '' THEN 'missing' WHEN coalesce(system_id, '') = '' "
    f"THEN 'invalid' ELSE 'accepted' END AS status FROM ({select_sql(_CALLER_COLUMNS, 'orders')}) LEFT JOIN "
    f"({select_sql(_TENANT_COLUMNS, 'nation')}) USING (api_key)"
)
ORACLES |= {
    "ten1_parse": f"WITH s AS ({select_sql(_SETTING_COLUMNS, 'customer')}) "
                  "SELECT setting_id, 'key_' || n AS api_key, 'sys_late' AS system_id FROM s UNION ALL "
                  "SELECT setting_id, 'k:' || n || ':z', 'sys_x' FROM s UNION ALL "
                  "SELECT setting_id, 'key_empty', '' FROM s WHERE setting_id % 2 = 0",
    "ten2_resolve": _RESOLVED_SQL,
    "ten3_rejects": f"SELECT call_id, status FROM ({_RESOLVED_SQL}) WHERE status <> 'accepted'",
}


def ten4_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session id used by every system: each keeps its own numbering."""
    calls = _calls(spark, sf_dir).withColumn("session_id", F.lit("shared"))
    mapping = mask_sessions(calls).mapping
    return mapping.groupBy("system_id", "entity_type").agg(
        F.count("*").alias("n_values"), F.max("epoch").alias("last_epoch"), F.max("idx").alias("last_idx"))


_SHARED = CALLS_CTE.replace("calls AS (SELECT *,", "calls AS (SELECT * REPLACE ('shared' AS session_id),", 1)
QUERIES["ten4_isolation"] = ten4_isolation
ORACLES["ten4_isolation"] = (
    f"WITH {_SHARED}, {OCCURRENCES_CTE}, {_EPOCH_CTE}, {_MAP_CTE} SELECT system_id, entity_type, count(*) AS n_values, "
    "max(epoch) AS last_epoch, max(idx) AS last_idx FROM mapping GROUP BY system_id, entity_type"
)


# --- one session of each system, with an epoch after every short silence --------

_SHORT_TTL = 600


def _many_epochs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Replies, and the mapping of sessions that expire hundreds of times."""
    calls = _calls(spark, sf_dir).withColumn("session_id", F.lit("shared"))
    replies = _replies(spark, sf_dir).withColumn("session_id", F.lit("shared"))
    return replies, mask_sessions(calls, ttl=_SHORT_TTL).mapping


def rs2_many_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies, mapping = _many_epochs(spark, sf_dir)
    back = restore_sessions(replies, mapping, ["system_id", "session_id", "reply_id"], ttl=_SHORT_TTL)
    return back.select("reply_id", "restored_text")


def rs7_many_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies, mapping = _many_epochs(spark, sf_dir)
    missing = unresolved(replies, mapping, ["system_id", "session_id", "reply_id"], ttl=_SHORT_TTL)
    return missing.groupBy("reply_id").agg(F.count("*").alias("n_missing"))


_SHARED_REPLIES = _REPLIES_CTE.replace("(SELECT *, ts", "(SELECT * REPLACE ('shared' AS session_id), ts", 1)
_SEEN_SHORT = f"WITH {_SHARED}, {OCCURRENCES_CTE}, {_epoch_cte(_SHORT_TTL)}, {_MAP_CTE}, {_SHARED_REPLIES}, {_live_cte(_SHORT_TTL)}, {_SEEN_CTE}"
QUERIES |= {"rs2_many_epochs": rs2_many_epochs, "rs7_many_epochs": rs7_many_epochs}
ORACLES |= {
    "rs2_many_epochs": f"{_SEEN_SHORT} SELECT reply_id, {_reply_text('got_phone', 'got_mail')} AS restored_text FROM "
                       f"({_filled_replies('seen', 'r.system_id', _BY_REPLY)})",
    "rs7_many_epochs": f"{_SEEN_SHORT} SELECT reply_id, count(*) AS n_missing FROM (SELECT reply_id, "
                       "unnest(['PHONE_NUMBER_' || cast(n % 3 as string), 'EMAIL_' || cast(n as string), 'UNKNOWN_0', 'EMAIL_00']) AS placeholder_key "
                       "FROM replies) p WHERE NOT EXISTS (SELECT 1 FROM seen m WHERE m.seen_by = p.reply_id AND m.placeholder_key = p.placeholder_key) "
                       "GROUP BY reply_id",
}

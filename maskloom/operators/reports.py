"""Reports over spans and masked texts.  None of them carries a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskloom.functions import rulebook as book
from maskloom.session import cut_lineage, join_hashed
from maskloom.sources.corpus import SESSION


def audit(detected: DataFrame, text_col: str = "text") -> DataFrame:
    """Per session: calls, characters and spans of each type, as columns."""
    counts = [
        F.sum(F.expr(f"size(filter(spans, s -> s.entity_type = '{t}'))")).cast("long").alias(f"n_{t.lower()}")
        for t in book.ENTITY_ORDER
    ]
    return detected.groupBy(*SESSION).agg(
        F.count("*").alias("calls"), F.sum(F.length(text_col)).cast("long").alias("text_length"), *counts)


def audit_rollup(spans: DataFrame) -> DataFrame:
    """Span counts by system and type, with totals (NULL keys)."""
    return spans.rollup("system_id", "entity_type").agg(F.count("*").alias("n"))


def quality(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall per type over distinct ``keys``: repeats count once."""
    key = list(dict.fromkeys([*keys, "entity_type"]))
    want = expected.select(*key).distinct().withColumn("wanted", F.lit(1))
    got = predicted.select(*key).distinct().withColumn("found", F.lit(1))
    both = want.join(got, key, "full_outer")
    count = {
        "tp": F.col("wanted").isNotNull() & F.col("found").isNotNull(),
        "fp": F.col("wanted").isNull(),
        "fn": F.col("found").isNull(),
    }
    totals = both.groupBy("entity_type").agg(
        *[F.sum(c.cast("long")).alias(n) for n, c in count.items()])

    def share(of: str) -> Column:
        whole = F.col("tp") + F.col(of)
        return F.when(whole > 0, F.round(F.col("tp") / whole, 4))

    return totals.withColumns({"precision": share("fp"), "recall": share("fn")})


def case_results(expected: DataFrame, predicted: DataFrame, case: str, keys: list[str]) -> DataFrame:
    """Pass or fail per case: every wanted span found and none besides."""
    want = expected.select(case, *keys).distinct().withColumn("wanted", F.lit(True))
    got = predicted.select(case, *keys).distinct().withColumn("found", F.lit(True))
    both = want.join(got, [case, *keys], "full_outer")
    agree = F.coalesce(F.col("wanted"), F.lit(False)) & F.coalesce(F.col("found"), F.lit(False))
    return both.groupBy(case).agg(F.bool_and(agree).alias("passed"))


_GRAM = 3
_BLOCK_CALLS = 64
#: Most values of a session that are looked for one by one in each of its texts.
_FEW_VALUES = 1024


def _grams(text: str, size: int) -> str:
    """All pieces of ``size`` characters of a text, in one pass."""
    return f"regexp_extract_all({text}, '(?s)(?=(.{{{size}}}))', 1)"


def known_values(mapping: DataFrame) -> DataFrame:
    """The values of each session, once each and written once; none is empty."""
    return cut_lineage(mapping.select(*SESSION, "entity_type", "value").distinct().where("value <> ''"))


def leaks(masked: DataFrame, mapping: DataFrame, call_key: list[str], known: DataFrame | None = None,
          few: int = _FEW_VALUES) -> DataFrame:
    """Values of a session, whichever of its calls they came from, still readable in one of its masked texts.

    Anywhere in the text, inside longer words too.  One row per call, type and value; the value itself is left out.

    A session with a ``few`` values at most has them in one list, which its texts meet: looking for
    each in each text is then cheaper than cutting the texts up.  Sessions with more go by pieces
    (see `_by_pieces`), and so do those in which calls of one key have different texts, as these count by pieces held.
    ``known`` are the mapping's values, where `known_values` has found them before.

    Lists and texts are more than the files they are read from tell, so no side is to be broadcast by the size of these.
    """
    keys = list(dict.fromkeys([*SESSION, *call_key]))
    values = known_values(mapping) if known is None else known
    texts = cut_lineage(masked.select(*keys, "masked_text"))
    calls, held = texts.dropna(subset=call_key), F.xxhash64("masked_text")
    again = cut_lineage(
        calls.groupBy(*keys).agg(F.count("*").cast("int").alias("times"), (F.min(held) != F.max(held)).alias("differ")).where("times > 1"))
    differing = again.where("differ").select(*SESSION).distinct()
    counts = values.groupBy(*SESSION).agg(F.count("*").alias("n"))
    lists = (
        values.join(counts.where(F.col("n") <= few).hint("merge"), SESSION, "left_semi")
        .join(differing.hint("merge"), SESSION, "left_anti")
        .groupBy(*SESSION).agg(F.collect_list(F.struct("entity_type", "value")).alias("wanted"))
    )
    repeated = not again.isEmpty()
    # Calls of one key count once for each other.
    counted = join_hashed(calls, again.drop("differ"), keys, "left") if repeated else calls
    readable = F.filter("wanted", lambda w: F.contains("masked_text", w["value"]))["entity_type"]
    # Through a one-row generator, or else the check for empty lists would look for all values once more.
    met = join_hashed(counted, lists, SESSION).select("*", F.inline(F.array(F.struct(readable.alias("types")))))
    types = F.flatten(F.array_repeat("types", F.coalesce("times", F.lit(1)))) if repeated else F.col("types")
    found = met.select(*call_key, F.explode(types).alias("entity_type"))
    others = cut_lineage(counts.where(F.col("n") > few).select(*SESSION).unionByName(differing).distinct())
    if others.isEmpty():
        return found
    rest = [rows.join(others.hint("merge"), SESSION, "left_semi") for rows in (texts, values)]
    return found.unionByName(_by_pieces(rest[0], cut_lineage(rest[1]), call_key))


def _by_pieces(masked: DataFrame, values: DataFrame, call_key: list[str]) -> DataFrame:
    """The same for sessions of any number of values, given once each.

    Every value is cut into all its pieces of three characters (a shorter value is its own
    piece), and so are the texts.  The texts of a session are dealt into blocks of some 64, so that what
    they have in common is moved once for a block, and no block grows with its session.  Pieces of texts
    meet those of their session's values, never the values themselves.  A value of which some piece stands in no
    text of its session is done with.  Any other meets the blocks that hold its rarest piece, and only there it is looked for.
    """
    # Which of the three lengths of pieces there are.
    sizes = sorted(r["size"] for r in values.select(F.least(F.length("value"), F.lit(_GRAM)).alias("size")).distinct().collect())
    if not sizes:
        return masked.where("false").select(*call_key, F.lit("").alias("entity_type"))
    cut = " ".join(f"WHEN length(value) {'>=' if n == _GRAM else '='} {n} THEN {_grams('value', n)}" for n in sizes)
    pieces = values.withColumn("gram", F.explode(F.expr(f"array_distinct(CASE {cut} END)")))
    texts = _in_blocks(masked, call_key)
    every = ", ".join(_grams("masked_text", n) for n in sizes)
    held = (
        texts.select(*SESSION, "block", F.explode(F.expr(f"array_distinct(concat({every}))")).alias("gram"))
        .groupBy("block", *SESSION, "gram").agg(F.count("*").alias("n"))
    )
    # Only pieces of the session's own values go on; the rest of a block's pieces ends here.
    own = pieces.select(*SESSION, "gram").distinct()
    met = cut_lineage(held.join(own.hint("merge"), [*SESSION, "gram"], "left_semi").select(*SESSION, "block", "gram", "n"))
    counts = met.groupBy(*SESSION, "gram").agg(F.sum("n").alias("n"))
    rarest = (
        pieces.join(counts.hint("merge"), [*SESSION, "gram"], "left")
        .groupBy(*SESSION, "entity_type", "value")
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("pieces"), F.count("n").alias("found"))
        .where("pieces = found").drop("pieces", "found")
    )
    candidates = met.join(rarest.hint("merge"), [*SESSION, "gram"]).select(*SESSION, "block", "entity_type", "value", "gram")
    keys = list(dict.fromkeys([*SESSION, *call_key]))
    holds = F.contains("masked_text", F.col("value"))
    # A piece that begins or ends inside a character of two halves is not found as such.
    looked = texts.join(candidates.hint("merge"), [*SESSION, "block"]).filter(holds | F.contains("masked_text", F.col("gram")))
    # Calls of one key count once for each of them that holds the piece.
    times = F.count("*") * F.count_if(holds)
    return (
        looked.dropna(subset=call_key).groupBy(*keys, "entity_type", "value").agg(times.cast("int").alias("times"))
        .select(*call_key, "entity_type", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("turn")).drop("turn")
    )


def _in_blocks(masked: DataFrame, call_key: list[str]) -> DataFrame:
    """The texts, written once, with the ``block`` of their session they are in."""
    keys = list(dict.fromkeys([*SESSION, *call_key]))
    calls = masked.groupBy(*SESSION).agg(F.count("*").alias("calls"))
    number = F.pmod(F.xxhash64(*keys), F.ceil(F.col("calls") / _BLOCK_CALLS))
    return cut_lineage(masked.select(*keys, "masked_text").join(calls.hint("merge"), SESSION).select(
        *keys, "masked_text", F.xxhash64(*SESSION, number).alias("block")))


def top_values(spans: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per system, as hashes.

    Counts are made before the ranking, so a frequent value costs one row.
    """
    counts = spans.groupBy("system_id", "entity_type", "value").agg(F.count("*").alias("n"))
    hashed = counts.withColumn("value_hash", F.sha2("value", 256)).drop("value")
    order = W.partitionBy("system_id").orderBy(F.desc("n"), "entity_type", "value_hash")
    return hashed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def rule_profile(spans: DataFrame, stages: dict[str, float]) -> DataFrame:
    """Hits and share per rule and stage; a stage keeps the spans with at least its score.

    The spans are read once: a span counts in each stage that keeps it.
    """
    kept = F.array_compact(F.array(*[F.when(F.col("score") >= least, name) for name, least in stages.items()]))
    rows = spans.select("rule", F.explode(kept).alias("stage")).groupBy("rule", "stage").agg(F.count("*").alias("hits"))
    total = W.partitionBy("stage")
    return rows.withColumn("share", F.round(F.col("hits") / F.sum("hits").over(total), 4))

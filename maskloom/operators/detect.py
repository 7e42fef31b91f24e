"""Detection: a table of texts gains an array of resolved spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import checks
from maskloom.functions import rulebook as book
from maskloom.functions.context import boosted
from maskloom.functions.resolve import disjoint, one_per_type, plain, rescored
from maskloom.functions.scan import raw_spans
from maskloom.functions.text import each, empty, let, quoted, when


MODEL_EN, MODEL_ZH = "model_en", "model_zh"
CONTEXT_MODES = ("all", "overlaps", "none")


def found_sql(text: str, entities: list[str] | None = None, profile: str = "default",
              extra: str | None = None) -> str:
    """Every match of the rules in a text.

    ``extra`` adds names found elsewhere, where PERSON is among the entities and the
    text is not blank; the form-field rule yields to those of a Chinese model.
    """
    found = raw_spans(text, book.rules_for(entities, profile))
    if extra is not None and (entities is None or "PERSON" in entities):
        names = when(f"{text} IS NULL OR trim({text}) = ''", empty(), extra)
        found = let(names, lambda e: f"concat({each('filter', found, lambda s: _stands(s, e))}, {e})")
    return found


def finishing(text: str, entities: list[str] | None = None, profile: str = "default", *, context: str = "all",
              threshold: float = 0.0, resolve: bool = True, merge_blanks: bool = True) -> list[Callable[[str], str]]:
    """The steps from found spans to finished ones: scores raised, weak ones dropped, overlaps resolved.

    ``context`` boosts the score of ``all`` spans, of those that overlap another
    (``overlaps``: enough to decide between them), or of ``none``.
    """
    if context not in CONTEXT_MODES:
        raise ValueError(f"context must be one of {CONTEXT_MODES}")
    if threshold > 0 and context == "overlaps":
        context = "all"
    types = sorted({r.entity_type for r in book.rules_for(entities, profile)}, key=book.priority_of)

    def scored(spans: str) -> str:
        out = spans
        if context == "overlaps" and resolve:
            out = rescored(spans, lambda run: boosted(text, run, types))
        elif context == "all":
            out = boosted(text, spans, types)
        return each("filter", out, lambda s: f"{s}.score >= {threshold}D") if threshold > 0 else out

    steps = [scored] if context != "none" or threshold > 0 else []
    if resolve:
        steps += [lambda spans: one_per_type(text, spans), lambda spans: disjoint(text, spans, merge_blanks)]
    else:
        steps.append(lambda spans: f"array_sort({spans})")
    return [lambda spans, step=step: when(f"size({spans}) > 0", step(spans), spans) for step in steps]


def _stands(s: str, names: str) -> str:
    same = each("exists", names, lambda m: f"({m}.rule = {quoted(MODEL_ZH)} AND {checks.overlap(s, m)})")
    return f"NOT ({s}.rule = 'D28' AND {same})"


def detect(df: DataFrame, text_col: str = "text", out: str = "spans", entities: list[str] | None = None,
           profile: str = "default", extra: str | None = None, **options) -> DataFrame:
    """Add the spans of ``text_col``; options go to `finishing`.  No shuffle.

    Each expression sits inside a one-row generator, so later filters on the spans
    read the finished column instead of repeating the detection.  There are several,
    because the analyzer resolves nested functions a level at a time, up to a limit.
    """
    text, column = f"`{text_col}`", "__found0"
    rows = df.select("*", F.inline(F.array(F.struct(F.expr(found_sql(text, entities, profile, extra)).alias(column)))))
    steps = finishing(text, entities, profile, **options)
    # Most texts hold nothing to resolve: that is seen once, and the steps are then passed over.
    settles = options.get("resolve", True) and options.get("context", "all") != "all" and options.get("threshold", 0) <= 0
    if settles:
        seen = [F.expr(f"sort_array({column})").alias("__sorted")]
        rows = rows.select("*", F.inline(F.array(F.struct(*seen)))).drop(column)
        column = "__sorted"
        same = F.expr(plain(text, column, options.get("merge_blanks", True))).alias("__plain")
        rows = rows.select("*", F.inline(F.array(F.struct(same))))
    for n, step in enumerate(steps, 1):
        after = out if n == len(steps) else f"__found{n}"
        done = when("__plain", column, step(column)) if settles else step(column)
        rows = rows.select("*", F.inline(F.array(F.struct(F.expr(done).alias(after))))).drop(column)
        column = after
    return rows.drop("__plain")


def span_rows(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span; a text without spans gives none."""
    return df.select(*keys, F.inline(F.col(spans)))


def score_milli(score: Column) -> Column:
    return F.round(score * 1000).cast("int").alias("score_milli")

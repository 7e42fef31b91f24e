"""Person names: spans from a language model's table, and a surname gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions import checks
from maskloom.functions import rulebook as book
from maskloom.functions.text import (
    each,
    let,
    mark,
    marked,
    marked_values,
    quoted,
    slice_of,
    span,
    when,
    without_marks,
)
from maskloom.operators.detect import MODEL_EN, MODEL_ZH, detect


def rejected_sql(value: str, lang: str) -> dict[str, str]:
    """The filters on a model's span, by name, in the order they apply."""
    is_zh = f"{lang} = 'zh'"
    return {
        "cjk": f"(NOT {is_zh} AND {checks.has_cjk(value)})",
        "punctuation": f"({is_zh} AND {checks.name_punctuation(value)})",
        "stop_word": checks.is_stop_word(value),
        "digits": checks.digits_only(value),
        "address": checks.address_prefix(value),
    }


def model_span_rows(df: DataFrame, model_spans: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Model spans with their value and the first filter that rejects them.

    ``model_spans`` is ``(key, start, end, lang)``; spans outside the text go.
    """
    joined = model_spans.join(df.select(key, F.col(text_col).alias("__text")), key)
    bounded = joined.filter("start >= 0 AND start < end AND end <= length(__text)")
    valued = bounded.withColumn("value", F.expr(slice_of("__text", "start", "end"))).drop("__text")
    branches = " ".join(f"WHEN {c} THEN '{n}'" for n, c in rejected_sql("value", "lang").items())
    return valued.withColumn("rejected_by", F.expr(f"CASE {branches} END"))


def _model_names(text: str, spans: str) -> str:
    """PERSON spans of an array of a model's spans; those outside the text or rejected by a filter go."""
    def named(s: str) -> str:
        rule = f"CASE WHEN {s}.lang = 'zh' THEN '{MODEL_ZH}' ELSE '{MODEL_EN}' END"
        return span(f"{s}.start", f"{s}.end", "'PERSON'", str(book.MODEL_SCORE), rule,
                    slice_of(text, f"{s}.start", f"{s}.end"))

    inside = each("filter", f"coalesce({spans}, array())",
                  lambda s: f"{s}.start >= 0 AND {s}.start < {s}.end AND {s}.end <= length({text})")
    lang = f"CASE WHEN {{s}}.rule = '{MODEL_ZH}' THEN 'zh' ELSE 'en' END"

    def kept(s: str) -> str:
        return f"NOT ({' OR '.join(rejected_sql(f'{s}.value', lang.format(s=s)).values())})"

    return let(each("transform", inside, named), lambda names: each("filter", names, kept))


def detect_with_model(df: DataFrame, model_spans: DataFrame, key: str, text_col: str = "text",
                      out: str = "spans", **options) -> DataFrame:
    """Detection with model spans ``(key, start, end, lang)`` joined in; takes the options of `detect`.

    Bare spans are gathered per text, so a text is shuffled once, to meet its own.
    """
    per_text = model_spans.groupBy(key).agg(F.collect_list(F.struct("start", "end", "lang")).alias("__model"))
    joined = df.join(per_text, key, "left")
    return detect(joined, text_col, out, extra=_model_names(f"`{text_col}`", "__model"), **options).drop("__model")


def _gazetteer_pattern() -> str:
    surname = f"(?:{'|'.join(book.COMPOUND_SURNAMES)}|[{book.SURNAMES}])"
    after = "|".join(book.NAME_ENDS)
    given = f"(?!{after})[一-鿿]"
    ends = f"(?=[^一-鿿]|{after}|$)"
    return f"{surname}(?:{given}){{1,2}}{ends}"


def gazetteer_sql(text: str) -> str:
    """Names found by surname.  A stand-in for a Chinese model, not its equal.

    Traditional characters are read as Simplified one for one, so offsets hold
    and the stored value stays as written.
    """
    plain = f"translate({without_marks(text)}, {quoted(book.TRADITIONAL)}, {quoted(book.SIMPLIFIED)})"
    found = let(mark(plain, _gazetteer_pattern()), lambda m: when(
        marked(m), marked_values(m), "CAST(array() AS array<struct<start:int,value:string>>)"))
    spans = each("transform", found, lambda v: span(
        f"{v}.start", f"{v}.start + length({v}.value)", "'PERSON'", "0.6", "'D32'",
        slice_of(text, f"{v}.start", f"{v}.start + length({v}.value)")))
    return when(f"rlike({text}, '[一-鿿]')", spans, "array()")


def detect_with_gazetteer(df: DataFrame, text_col: str = "text", out: str = "spans", **options) -> DataFrame:
    """Detection plus gazetteer names."""
    return detect(df, text_col, out, extra=gazetteer_sql(f"`{text_col}`"), **options)

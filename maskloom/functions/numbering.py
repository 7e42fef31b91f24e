"""Placeholders inside one text: numbering, mapping entries, rewriting."""

from __future__ import annotations

from collections.abc import Callable

from maskloom.functions.text import each, gaps, let, quoted, splice, when, with_lookup

ENTRY_TYPE = "array<struct<entity_type:string,idx:int,placeholder_key:string,value:string>>"
PLACEHOLDER = r"\{\{([A-Z_]+)_([0-9]+)\}\}"
ORDERS = ("right_to_left", "left_to_right")


def check_order(order: str) -> None:
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")


def value_key(s: str) -> str:
    """Type and value of a span as one string; no type holds a line break."""
    return f"concat({s}.entity_type, '\\n', {s}.value)"


def values_in(spans: str, order: str = "right_to_left") -> str:
    """The distinct value keys of the spans, as they are numbered."""
    check_order(order)
    items = f"reverse({spans})" if order == "right_to_left" else spans
    return f"array_distinct({each('transform', items, value_key)})"


#: Up to so many values, looking through all of them is the fastest.
_FEW = 16


def cut_text(text: str, spans: str, order: str = "right_to_left") -> str:
    """``struct<pieces, seats, tail>``: the text before each (sorted, disjoint) span, the place of its value
    among `values_in`, and the text after the last span.  Nothing of a value is left in it."""
    def seats(keys: str) -> str:
        few = each("transform", spans, lambda s: f"CAST(array_position({keys}, {value_key(s)}) - 1 AS INT)")
        many = with_lookup(f"transform({keys}, (k, i) -> named_struct('k', k, 'v', i))",
                           lambda get: each("transform", spans, lambda s: get(value_key(s))))
        return when(f"size({keys}) <= {_FEW}", few, many)

    return (
        f"named_struct('pieces', {gaps(text, spans)}, 'seats', {let(values_in(spans, order), seats)}, "
        f"'tail', substring({text}, element_at({spans}, -1).end + 1))"
    )


def filled(cut: str, marks: str) -> str:
    """The text of `cut_text` with a placeholder in each gap: ``marks`` has a ``mark`` for each place, in their order.

    A place may come twice with one mark, but with two it is an error.
    """
    def fill(items: str) -> str:
        done = f"concat(array_join(zip_with({cut}.pieces, {cut}.seats, (p, n) -> concat(p, get({items}, n).mark)), ''), {cut}.tail)"
        return when(f"size({items}) = array_max({cut}.seats) + 1", done, "raise_error('a value has several numbers')")

    return let(when(f"size({marks}) > array_max({cut}.seats) + 1", f"array_distinct({marks})", marks), fill)


def entries(spans: str, order: str = "right_to_left") -> str:
    """Each distinct (type, value) with its number; types count on their own."""
    keys = values_in(spans, order)

    def of_type(all_keys: str) -> str:
        def numbered(t: str) -> str:
            own = each("filter", all_keys, lambda k: f"startswith({k}, concat({t}, '\\n'))")
            return (
                f"transform({own}, (k, i) -> named_struct('entity_type', {t}, 'idx', i, "
                f"'placeholder_key', concat({t}, '_', i), 'value', substring(k, length({t}) + 2)))"
            )

        types = f"array_distinct({each('transform', spans, lambda s: f'{s}.entity_type')})"
        return f"flatten({each('transform', types, numbered)})"

    none = f"CAST(array() AS {ENTRY_TYPE})"
    return when(f"size({spans}) > 0", let(keys, of_type), none)


def rewritten(text: str, spans: str, found: str) -> str:
    """The text with every span replaced by its entry's placeholder."""
    pairs = each("transform", found, lambda e: (
        f"named_struct('k', concat({e}.entity_type, '\\n', {e}.value), "
        f"'v', concat('{{{{', {e}.placeholder_key, '}}}}'))"))
    return when(
        f"size({spans}) > 0",
        with_lookup(pairs, lambda get: splice(text, spans, lambda s: get(value_key(s)))),
        text,
    )


def mapping_of(found: str) -> str:
    """``map<placeholder key, value>``; NULL when nothing was found."""
    pairs = each("transform", found, lambda e: f"struct({e}.placeholder_key, {e}.value)")
    return when(f"size({found}) > 0", f"map_from_entries({pairs})", "NULL")


def placeholders_in(text: str) -> str:
    """Distinct placeholder keys (``TYPE_N``) written in a text."""
    keys = f"regexp_extract_all({text}, {quoted(PLACEHOLDER)}, 0)"
    bare = each("transform", keys, lambda k: f"substring({k}, 3, length({k}) - 4)")
    return when(f"contains({text}, '{{{{')", f"array_distinct({bare})", "CAST(array() AS array<string>)")


def restored(text: str, mapping: str) -> str:
    """Known placeholders give way to their values, in one pass; others stay."""
    def fill(pieces: str, keys: str, known: Callable[[str], str]) -> str:
        key = f"get({keys}, i)"
        value = f"coalesce({known(f'substring({key}, 3, length({key}) - 4)')}, {key}, '')"
        return f"array_join(transform({pieces}, (p, i) -> concat(p, {value})), '')"

    pattern = quoted(PLACEHOLDER)
    pairs = each("transform", f"map_entries({mapping})", lambda e: f"named_struct('k', {e}.key, 'v', {e}.value)")
    done = let(f"split({text}, {pattern})", lambda pieces: let(
        f"regexp_extract_all({text}, {pattern}, 0)", lambda keys: with_lookup(
            pairs, lambda known: fill(pieces, keys, known))))
    return when(f"{mapping} IS NOT NULL AND contains({text}, '{{{{')", done, text)

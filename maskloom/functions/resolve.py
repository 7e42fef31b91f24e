"""Overlap resolution of spans inside one text.

A few spans are compared with each other.  Many are cut into runs that overlap, and each run
is swept once in sorted order with the furthest end so far, so the time grows with the
spans however long a run is.
"""

from __future__ import annotations

from collections.abc import Callable

from maskloom.functions import rulebook as book
from maskloom.functions.text import apart, each, empty, gaps, let, per_island, quoted, running_reach, runs, span, when

#: Up to so many spans, comparing each with each is the fastest.
_FEW = 16


def _ordered(run: str, keys: list[Callable[[str], str]]) -> str:
    """The run sorted by start, then the furthest end first, then ``keys``."""
    def keyed(s: str) -> str:
        more = ", ".join(f"'k{i}', {key(s)}" for i, key in enumerate(keys))
        return f"named_struct('start', {s}.start, 'back', -{s}.end, {more}, 's', {s})"

    return each("transform", f"array_sort({each('transform', run, keyed)})", lambda x: f"{x}.s")


def _outstanding(ordered: str, same: Callable[[str, str], str]) -> str:
    """Of sorted spans those that reach beyond all before them; ``same`` ones stand or fall together."""
    def sweep(items: str) -> str:
        def kept(reach: str) -> str:
            return "flatten(" + runs(
                items, lambda i: f"NOT ({items}[{i}].start = {items}[{i} - 1].start AND {items}[{i}].end = {items}[{i} - 1].end "
                                 f"AND {same(f'{items}[{i}]', f'{items}[{i} - 1]')})",
                lambda first, last: when(f"{first} = 0 OR {reach}[{first} - 1] < {items}[{first}].end",
                                         f"slice({items}, {first} + 1, {last} - {first} + 1)", empty())) + ")"

        return let(running_reach(items), kept)

    return let(ordered, sweep)


def without_contained(run: str) -> str:
    """R1: of one type, drop a span inside a better one (score, start, length)."""
    def better(y: str, x: str) -> str:
        return (
            f"({y}.entity_type = {x}.entity_type AND {y}.start <= {x}.start AND {y}.end >= {x}.end "
            f"AND ({y}.score > {x}.score OR ({y}.score = {x}.score AND ({y}.start < {x}.start OR "
            f"{y}.end > {x}.end OR {y}.rule < {x}.rule))))"
        )

    return each("filter", run, lambda x: f"NOT {each('exists', run, lambda y: better(y, x))}")


def without_contained_swept(run: str) -> str:
    """The same in one sweep for each type and score; there are few of these, whatever the text."""
    def of_level(items: str, lv: str) -> str:
        rivals = each("filter", items, lambda s: f"{s}.entity_type = {lv}.entity_type AND {s}.score >= {lv}.score")
        standing = _outstanding(rivals, lambda x, y: f"{x}.score = {y}.score AND {x}.rule = {y}.rule")
        return each("filter", standing, lambda x: f"{x}.score = {lv}.score")

    def sweep(items: str) -> str:
        levels = "array_distinct(" + each(
            "transform", items, lambda s: f"named_struct('entity_type', {s}.entity_type, 'score', {s}.score)") + ")"
        return f"flatten({each('transform', levels, lambda lv: of_level(items, lv))})"

    return let(_ordered(run, [lambda s: f"-{s}.score", lambda s: f"{s}.rule"]), sweep)


def merged_same_type(text: str, run: str) -> str:
    """R2: overlapping spans of one type become their union with the best score and the first one's rule."""
    by_type = each("transform", f"array_sort({each('transform', run, lambda s: f'named_struct(\'t\', {s}.entity_type, \'s\', {s})')})",
                   lambda x: f"{x}.s")
    last = "element_at(acc, -1)"
    value = f"concat({last}.value, substring(s.value, {last}.end - s.start + 1))"
    union = span(f"{last}.start", f"greatest({last}.end, s.end)", "s.entity_type",
                 f"greatest({last}.score, s.score)", f"{last}.rule", value)
    touching = f"size(acc) > 0 AND {last}.entity_type = s.entity_type AND s.start < {last}.end"
    step = when(touching, f"concat(slice(acc, 1, size(acc) - 1), array({union}))", "concat(acc, array(s))")
    return f"aggregate({by_type}, {empty()}, (acc, s) -> {step})"


def merged_same_type_swept(run: str) -> str:
    """The same in one sweep for each type."""
    def islands_of(items: str) -> str:
        def joined(reach: str) -> str:
            def union(first: str, last: str) -> str:
                tails = each("transform", f"sequence({first}, {last})", lambda k: when(
                    f"{k} = {first}", f"{items}[{k}].value",
                    f"substring({items}[{k}].value, {reach}[{k} - 1] - {items}[{k}].start + 1)"))
                best = f"array_max({each('transform', f'slice({items}, {first} + 1, {last} - {first} + 1)', lambda s: f'{s}.score')})"
                one = f"{items}[{first}]"
                whole = span(f"{one}.start", f"{reach}[{last}]", f"{one}.entity_type", best, f"{one}.rule", f"array_join({tails}, '')")
                return when(f"{first} = {last}", one, whole)

            return runs(items, lambda i: f"{items}[{i}].start >= {reach}[{i} - 1]", union)

        return let(running_reach(items), joined)

    types = "array_distinct(" + each("transform", run, lambda s: f"{s}.entity_type") + ")"

    def of_type(items: str, t: str) -> str:
        return let(each("filter", items, lambda s: f"{s}.entity_type = {t}"), islands_of)

    return let(f"array_sort({run})", lambda items: when(
        f"size({items}) > 1", f"flatten({each('transform', types, lambda t: of_type(items, t))})", items))


def _rank(s: str) -> str:
    return f"find_in_set({s}.entity_type, {quoted(','.join(book.ENTITY_ORDER + book.EXTENDED_ENTITIES))})"


def without_conflicts(run: str) -> str:
    """R3, R4: equal span: the higher score stays, then the earlier entity type;
    a span inside a longer one of another type goes whatever its score."""
    def beaten(x: str, y: str) -> str:
        same = f"{y}.start = {x}.start AND {y}.end = {x}.end"
        wins = f"({y}.score > {x}.score OR ({y}.score = {x}.score AND {_rank(y)} < {_rank(x)}))"
        inside = (
            f"{y}.start <= {x}.start AND {y}.end >= {x}.end AND "
            f"({y}.start < {x}.start OR {y}.end > {x}.end)"
        )
        return f"(({same} AND {wins}) OR ({inside}))"

    return each("filter", run, lambda x: f"NOT {each('exists', run, lambda y: beaten(x, y))}")


def without_conflicts_swept(run: str) -> str:
    """The same in one sweep."""
    return _outstanding(_ordered(run, [lambda s: f"-{s}.score", _rank]),
                        lambda x, y: f"{x}.score = {y}.score AND {x}.entity_type = {y}.entity_type")


def clipped(text: str, run: str) -> str:
    """R5: the left one of two overlapping spans ends where the next begins.

    Its stored value is clipped too, so restoring gives the text back exactly.
    """
    def cut(items: str) -> str:
        end = f"least(s.end, coalesce(get({items}, i + 1).start, s.end))"
        value = f"substring(s.value, 1, {end} - s.start)"
        return f"transform({items}, (s, i) -> {span('s.start', end, 's.entity_type', 's.score', 's.rule', value)})"

    return let(f"array_sort({run})", cut)


def merged_across_blanks(text: str, spans: str) -> str:
    """R6: neighbours of one type with only spaces between become one span, with the last one's score and rule."""
    def merge(items: str) -> str:
        def joined(between: str) -> str:
            def begins(i: str) -> str:
                return (
                    f"NOT ({items}[{i}].entity_type = {items}[{i} - 1].entity_type AND {items}[{i}].start > {items}[{i} - 1].end "
                    f"AND rlike({between}[{i}], '^ +$'))"
                )

            def union(first: str, last: str) -> str:
                values = each("transform", f"sequence({first}, {last})", lambda k: (
                    f"concat(CASE WHEN {k} = {first} THEN '' ELSE {between}[{k}] END, {items}[{k}].value)"))
                end = f"{items}[{last}]"
                whole = span(f"{items}[{first}].start", f"{end}.end", f"{end}.entity_type", f"{end}.score",
                             f"{end}.rule", f"array_join({values}, '')")
                return when(f"{first} = {last}", f"{items}[{first}]", whole)

            return runs(items, begins, union)

        return let(gaps(text, items), joined)

    return let(spans, lambda given: when(
        f"size({given}) > 1", let(f"array_sort({given})", merge), given))


def rescored(spans: str, rescore: Callable[[str], str]) -> str:
    """Spans with their scores worked out anew, of a few spans only where they overlap: elsewhere no score decides."""
    return let(spans, lambda given: when(f"size({given}) <= {_FEW}", per_island(given, rescore), rescore(given)))


def _settled(spans: str, few: list[Callable[[str], str]], many: list[Callable[[str], str]]) -> str:
    def chain(run: str, steps: list[Callable[[str], str]]) -> str:
        for step in steps:
            run = let(run, step)
        return run

    return let(spans, lambda given: when(
        f"size({given}) <= {_FEW}", per_island(given, lambda run: chain(run, few)), chain(given, many)))


def one_per_type(text: str, spans: str) -> str:
    """R1, R2: spans of one type no longer overlap."""
    return _settled(spans, [without_contained, lambda r: merged_same_type(text, r)],
                    [without_contained_swept, merged_same_type_swept])


def disjoint(text: str, spans: str, merge_blanks: bool = True) -> str:
    """R3 to R6 after that; the result is sorted by start and disjoint.

    Clipping never opens a gap, so it commutes with the merge across blanks.
    """
    def settled(items: str) -> str:
        found = clipped(text, _settled(items, [without_conflicts], [without_conflicts_swept]))
        return merged_across_blanks(text, found) if merge_blanks else found

    return let(f"sort_array({spans})", lambda items: when(plain(text, items, merge_blanks), items, settled(items)))


def plain(text: str, items: str, merge_blanks: bool = True) -> str:
    """A few sorted spans that neither overlap nor have only blanks between them: all steps leave them as they are."""
    blank = (
        f" OR ({items}[i].entity_type = {items}[i - 1].entity_type AND {items}[i].start > {items}[i - 1].end "
        f"AND rlike(substring({text}, {items}[i - 1].end + 1, {items}[i].start - {items}[i - 1].end), '^ +$'))"
    )
    return f"CASE WHEN size({items}) BETWEEN 2 AND {_FEW} THEN {apart(items, blank if merge_blanks else '')} ELSE false END"


def resolved(text: str, spans: str, merge_blanks: bool = True) -> str:
    """All steps in one."""
    return disjoint(text, one_per_type(text, spans), merge_blanks)

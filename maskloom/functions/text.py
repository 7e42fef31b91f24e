"""Spark SQL fragments for finding and replacing pieces of text.

The fragments are strings: nested higher-order functions are long, and one
``F.expr`` call builds them far faster than thousands of Column calls.

Offsets are code points.  They come from ``length()`` of text pieces, never from
a Java matcher (which counts UTF-16 units): a match is wrapped in a marker
character, the text is split at the marker, and the pieces are measured.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

MARK = "\ue000"
CUT = "\ue001"
STAND_IN = "\ue002"
_BLOCK = 256
_FEW_PIECES = 9

SPAN_TYPE = (
    "array<struct<start:int,end:int,entity_type:string,score:double,rule:string,value:string>>"
)
_names = itertools.count()


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: list[str]) -> str:
    return "array(" + ", ".join(quoted(v) for v in values) + ")"


def each(function: str, items: str, body: Callable[[str], str]) -> str:
    """``function(items, x -> body)`` with a variable name of its own."""
    x = f"x{next(_names)}"
    return f"{function}({items}, {x} -> {body(x)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once for ``body``, so it is not evaluated again per use."""
    return f"get({each('transform', f'array({value})', body)}, 0)"


def when(condition: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


def empty(kind: str = SPAN_TYPE) -> str:
    return f"CAST(array() AS {kind})"


def span(start: str, end: str, entity: str, score: str, rule: str, value: str) -> str:
    return (
        f"named_struct('start', CAST({start} AS INT), 'end', CAST({end} AS INT), "
        f"'entity_type', {entity}, 'score', CAST({score} AS DOUBLE), 'rule', {rule}, 'value', {value})"
    )


def slice_of(text: str, start: str, end: str) -> str:
    """Code points ``start`` (counted from 0) up to ``end``."""
    return f"substring({text}, {start} + 1, {end} - {start})"


def marked(text: str) -> str:
    return f"contains({text}, {quoted(MARK)})"


def has_marks(text: str) -> str:
    return f"({marked(text)} OR contains({text}, {quoted(CUT)}))"


def without_marks(text: str) -> str:
    """Swap stray marker characters one for one; no rule tells them apart."""
    swap = f"translate({text}, {quoted(MARK + CUT)}, {quoted(STAND_IN * 2)})"
    return when(has_marks(text), swap, text)


def mark(text: str, pattern: str, value_group: int = 0) -> str:
    """Wrap every match in markers; with a value group, only that last group."""
    wrap = f"{MARK}$0{MARK}" if value_group == 0 else f"$1{MARK}${value_group}{MARK}"
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(wrap)})"


def piece_starts(pieces: str) -> str:
    """Offset of every piece: running length.

    Past one block, lengths are summed block by block, so that a text with very
    many matches does not pay a quadratic copy of the growing array.
    """
    def run(block: str, base: str) -> str:
        return (
            f"aggregate({block}, named_struct('out', CAST(array() AS array<int>), 'pos', {base}), "
            "(a, p) -> named_struct('out', concat(a.out, array(a.pos)), 'pos', a.pos + length(p)), "
            "a -> a.out)"
        )

    blocks = each("transform", f"sequence(1, size({pieces}), {_BLOCK})",
                  lambda i: f"slice({pieces}, {i}, {_BLOCK})")
    bases = (
        "aggregate({b}, array(0), (acc, block) -> concat(acc, array(element_at(acc, -1) + "
        "aggregate(block, 0, (n, p) -> n + length(p)))))"
    )
    many = let(blocks, lambda b: f"flatten(zip_with({b}, slice({bases.format(b=b)}, 1, size({b})), "
                                 f"(block, base) -> {run('block', 'base')}))")
    return when(f"size({pieces}) <= {_BLOCK}", run(pieces, "0"), many)


def at_odd(pieces: str, body: Callable[[str], str]) -> str:
    """``body(i)`` for the index of every marked piece (they alternate)."""
    return each("transform", f"sequence(1, size({pieces}) - 2, 2)", body)


def with_starts(pieces: str, body: Callable[[Callable[[str], str]], str]) -> str:
    """``body(start)`` where ``start(i)`` is the offset of a piece; of a few pieces those before are measured anew each time."""
    few = body(lambda i: f"length(array_join(slice({pieces}, 1, {i}), ''))")
    return when(f"size({pieces}) <= {_FEW_PIECES}", few, let(piece_starts(pieces), lambda starts: body(lambda i: f"{starts}[{i}]")))


def marked_values(text: str) -> str:
    """``array<struct<start, value>>`` of the marked pieces of a marked text."""
    def read(pieces: str) -> str:
        one = f"array(named_struct('start', length({pieces}[0]), 'value', {pieces}[1]))"
        many = with_starts(pieces, lambda start: at_odd(
            pieces, lambda i: f"named_struct('start', {start(i)}, 'value', {pieces}[{i}])"))
        return when(f"size({pieces}) = 3", one, many)

    return let(f"split({text}, {quoted(MARK)})", read)


def gaps(text: str, spans: str) -> str:
    """The text before each (sorted, disjoint) span, back to the one before.

    Block by block: a substring is read from the start of the block's text, not of
    the whole, so many spans in a long text stay cheap.
    """
    def block_at(items: str, i: str) -> str:
        base = f"coalesce(get({items}, {i} - 2).end, 0)"
        block = f"slice({items}, {i}, {_BLOCK})"

        def cut(b: str) -> str:
            head = f"named_struct('base', {b}.base, 'text', substring({text}, {b}.base + 1, element_at({b}.block, -1).end - {b}.base))"

            def inside(h: str) -> str:
                x, j = f"x{next(_names)}", f"j{next(_names)}"
                prev = f"coalesce(get({b}.block, {j} - 1).end, {b}.base)"
                return f"transform({b}.block, ({x}, {j}) -> substring({h}.text, {prev} - {h}.base + 1, {x}.start - {prev}))"

            return let(head, inside)

        return let(f"named_struct('base', {base}, 'block', {block})", cut)

    return let(spans, lambda items: "flatten(" + each(
        "transform", f"sequence(1, size({items}), {_BLOCK})", lambda i: block_at(items, i)) + ")")


def splice(text: str, spans: str, replacement: Callable[[str], str]) -> str:
    """``text`` with every (sorted, disjoint) span replaced."""
    def edit(items: str) -> str:
        x, g = f"x{next(_names)}", f"g{next(_names)}"
        pieces = f"zip_with({gaps(text, items)}, {items}, ({g}, {x}) -> concat({g}, {replacement(x)}))"
        tail = f"substring({text}, element_at({items}, -1).end + 1)"
        return when(f"size({items}) > 0", f"concat(array_join({pieces}, ''), {tail})", text)

    return let(spans, edit)


def with_lookup(pairs: str, body: Callable[[Callable[[str], str]], str]) -> str:
    """``body(get)`` where ``get(key)`` reads the (key ``k``, value ``v``) ``pairs``; NULL for other keys.

    A map is searched entry by entry, so many entries are dealt into small maps by hash.
    """
    def tables(given: str) -> str:
        many = f"CASE WHEN size({given}) <= {_BLOCK} THEN 1 ELSE {_BLOCK} END"
        own = each("transform", f"sequence(0, {many} - 1)", lambda n: "map_from_entries(" + each(
            "filter", given, lambda p: f"pmod(hash({p}.k), {many}) = {n}") + ")")
        return let(own, lambda t: body(lambda key: f"element_at(get({t}, pmod(hash({key}), size({t}))), {key})"))

    return let(pairs, tables)


def running_reach(spans: str) -> str:
    """Furthest end of each span and all before it."""
    def run(block: str, base: str) -> str:
        return (
            f"aggregate({block}, named_struct('out', CAST(array() AS array<int>), 'reach', {base}), "
            "(a, s) -> named_struct('out', concat(a.out, array(greatest(a.reach, s.end))), 'reach', greatest(a.reach, s.end)), "
            "a -> a.out)"
        )

    def many(items: str) -> str:
        blocks = each("transform", f"sequence(1, size({items}), {_BLOCK})", lambda i: f"slice({items}, {i}, {_BLOCK})")
        bases = (
            "aggregate({b}, array(0), (acc, block) -> concat(acc, array(greatest(element_at(acc, -1), "
            "array_max(transform(block, s -> s.end))))))"
        )
        return let(blocks, lambda b: f"flatten(zip_with({b}, slice({bases.format(b=b)}, 1, size({b})), "
                                     f"(block, base) -> {run('block', 'base')}))")

    return let(spans, lambda items: when(f"size({items}) <= {_BLOCK}", run(items, "0"), many(items)))


def runs(items: str, begins: Callable[[str], str], body: Callable[[str, str], str]) -> str:
    """``body(first, last)`` for each run of ``items``; ``begins(i)`` tells where one begins, besides at 0."""
    def cut(starts: str) -> str:
        st, j = f"x{next(_names)}", f"j{next(_names)}"
        return f"transform({starts}, ({st}, {j}) -> {body(st, f'(coalesce(get({starts}, {j} + 1), size({items})) - 1)')})"

    return let(each("filter", f"sequence(0, size({items}) - 1)", lambda i: f"{i} = 0 OR {begins(i)}"), cut)


def islands(spans: str) -> str:
    """Sorted spans cut into runs that overlap; spans of two runs never do."""
    def cut(items: str) -> str:
        return let(running_reach(items), lambda reach: runs(
            items, lambda i: f"{items}[{i}].start >= {reach}[{i} - 1]",
            lambda first, last: f"slice({items}, {first} + 1, {last} - {first} + 1)"))

    return let(f"array_sort({spans})", cut)


def apart(items: str, more: str = "", first: str = "i") -> str:
    """True when no two neighbours of at least two sorted spans overlap, so no two at all; nor does ``more`` hold for any ``i``."""
    return f"NOT exists(sequence(1, size({items}) - 1), {first} -> {items}[{first}].start < {items}[{first} - 1].end{more})"


def per_island(spans: str, body: Callable[[str], str]) -> str:
    """Apply ``body`` to each overlapping run; lone spans pass through, at little cost where all are."""
    def settled(items: str) -> str:
        return when(apart(items), items, "flatten(" + each(
            "transform", islands(items), lambda run: when(f"size({run}) > 1", body(run), run)) + ")")

    return let(spans, lambda items: when(f"size({items}) > 1", let(f"sort_array({items})", settled), items))

"""Context boost: a value near a telling word scores higher.

The words before a value are cut on blanks and punctuation.  The boost looks at
the last five that are not stop words, or six when the value is glued to the
last one, however far back they lie.

A text with many values is cut into a block for every 64 of them.  What a block needs to know of
the text before it are the last words there; they are handed on from block to block, so
the text is read once for them all.
"""

from __future__ import annotations

import re

from maskloom.functions import rulebook as book
from maskloom.functions.text import each, gaps, let, quoted, when

# How far to look first; further only where too few words were found.
_REACHES = (256, 4096)
# Up to so many values look at the text itself, more at blocks of it.
_FEW = 64
_WORD = r"[\p{L}\p{N}_+]"
_SKIP = (
    "a an the is are was were be been of to in on at for and or my your his her its our "
    "their this that it i we you as by with from"
).split()

# Whole words that are no stop words, found in one pass however many of the others there are.
_COUNTS = rf"(?<!{_WORD})(?!(?:{'|'.join(_SKIP)})(?!{_WORD})){_WORD}++"


def _terms(entity: str) -> str:
    # A token holds no blank, so a term of several words can never be inside one.
    words = [w.lower() for w in book.CONTEXT_TERMS[entity] if " " not in w]
    return "|".join(re.escape(w) for w in words)


def _last_words(text: str, start: str) -> str:
    """The words that count just before ``start``, joined by line breaks."""
    def found_within(reach: int | None) -> str:
        part, complete = f"substring({text}, 1, {start})", "true"
        if reach is not None:
            part = f"substring({text}, greatest({start} - {reach} + 1, 1), least({start}, {reach}))"
            complete = f"{start} <= {reach}"

        def look(before: str) -> str:
            # The first word of a part may be the end of a longer one.
            whole_words = when(complete, before, f"regexp_replace({before}, {quoted('^' + _WORD + '+')}, '')")
            words = f"regexp_extract_all({whole_words}, {quoted(_COUNTS)}, 0)"
            count = when(f"rlike({before}, {quoted(_WORD + '$')})",
                         str(book.CONTEXT_TOKENS + 1), str(book.CONTEXT_TOKENS))
            return let(words, lambda w: (
                f"CASE WHEN {complete} OR size({w}) >= {count} THEN "
                f"array_join(slice({w}, greatest(size({w}) - {count} + 1, 1), {count}), '\\n') END"))

        return let(f"lower({part})", look)

    # The next is only evaluated where the one before has found too few words.
    return f"coalesce({', '.join(found_within(r) for r in (*_REACHES, None))})"


def near_context(text: str, start: str, entity: str, entities: list[str]) -> str:
    """True when one of the entity's terms lies in a word just before ``start``."""
    branches = " ".join(
        f"WHEN {quoted(e)} THEN rlike(near, {quoted(_terms(e))})"
        for e in entities if e in book.CONTEXT_TERMS
    )
    if not branches:
        return "false"
    return f"get(transform(array({_last_words(text, start)}), near -> CASE {entity} {branches} ELSE false END), 0)"


def _end_of(text: str) -> str:
    """A short text with the same last words that count; a word that may go on in what follows stays as it is."""
    def short(before: str) -> str:
        words = f"regexp_extract_all({before}, {quoted(_WORD + '+')}, 0)"

        def kept(w: str) -> str:
            open_end = f"rlike({before}, {quoted(_WORD + '$')})"
            # The last word is only judged when it is complete.
            done = when(open_end, f"slice({w}, 1, size({w}) - 1)", w)
            count = each("filter", done, lambda x: f"find_in_set(lower({x}), {quoted(','.join(_SKIP))}) = 0")
            last = let(count, lambda c: f"slice({c}, greatest(size({c}) - {book.CONTEXT_TOKENS}, 1), {book.CONTEXT_TOKENS + 1})")
            return f"concat(array_join({last}, ' '), ' ', {when(open_end, f'element_at({w}, -1)', quoted(''))})"

        return let(words, kept)

    return let(text, short)


def _blocks(text: str, spans: str) -> str:
    """``array<struct<text, shift, spans>>``: each block's text, what its offsets move by, and its spans."""
    whole = f"array(named_struct('text', {text}, 'shift', 0, 'spans', {spans}))"

    def many(items: str) -> str:
        starts = each("transform", f"sequence(0, size({items}) - 1, {_FEW})", lambda i: (
            f"named_struct('start', {items}[{i}].start, 'end', {items}[{i}].start)"))

        def cut(bounds: str) -> str:
            before = gaps(text, bounds)

            def joined(pieces: str) -> str:
                x = "concat(element_at(acc, -1), p)"
                ends = f"aggregate({pieces}, array(''), (acc, p) -> concat(acc, array({_end_of(x)})))"
                rest = f"substring({text}, element_at({bounds}, -1).start + 1, element_at({items}, -1).start - element_at({bounds}, -1).start)"

                def block(ends: str, k: str) -> str:
                    end = f"{ends}[{k} + 1]"
                    own = f"coalesce(get({pieces}, {k} + 1), {rest})"
                    return (
                        f"named_struct('text', concat({end}, {own}), 'shift', length({end}) - {bounds}[{k}].start, "
                        f"'spans', slice({items}, {k} * {_FEW} + 1, {_FEW}))"
                    )

                return let(ends, lambda e: each("transform", f"sequence(0, size({bounds}) - 1)", lambda k: block(e, k)))

            return let(before, joined)

        return let(starts, cut)

    return when(f"size({spans}) <= {_FEW}", whole, let(f"array_sort({spans})", many))


def boosted(text: str, spans: str, entities: list[str]) -> str:
    """Spans with +0.35, at least 0.4 and at most 1, when context is near."""
    def raise_score(s: str, block: str) -> str:
        better = (
            f"least(greatest(round({s}.score + {book.CONTEXT_BOOST}D, 4), {book.CONTEXT_FLOOR}D), 1.0D)"
        )
        near = near_context(f"{block}.text", f"({s}.start + {block}.shift)", f"{s}.entity_type", entities)
        return (
            f"named_struct('start', {s}.start, 'end', {s}.end, 'entity_type', {s}.entity_type, "
            f"'score', {when(near, better, f'{s}.score')}, 'rule', {s}.rule, 'value', {s}.value)"
        )

    return let(spans, lambda given: "flatten(" + each("transform", _blocks(text, given), lambda b: each(
        "transform", f"{b}.spans", lambda s: raise_score(s, b))) + ")")

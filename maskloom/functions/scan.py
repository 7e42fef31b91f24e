"""Find every rule's matches in a text, as one expression.

The number-shaped rules would each walk the whole text.  Instead one pass cuts
out the runs that hold at least four digits, with the few characters around
them that a rule can look at, and the rules run on those short pieces.  The
other rules run behind cheap gates that most texts fail.
"""

from __future__ import annotations

from collections.abc import Callable

from maskloom.functions import checks
from maskloom.functions import rulebook as book
from maskloom.functions.rulebook import Rule
from maskloom.functions.text import (
    CUT,
    MARK,
    at_odd,
    each,
    empty,
    has_marks,
    let,
    mark,
    marked,
    marked_values,
    per_island,
    quoted,
    slice_of,
    span,
    when,
    with_starts,
    without_marks,
)

# A number-shaped value is at most three characters (two letters and a blank, or
# a plus) followed by nothing but these, and HKID's closing "A)".
_RUN = r"(?U)\d(?:[\s()+./-]*+\d){3}[\d\s()+./-]*+"
_BEFORE, _AFTER = 4, 2
_HAN = "[一-鿿]"
_BLANK = r"(?U:\s)"


# Characters without which a rule cannot match; the Kelvin sign folds to K.
_MUST_HOLD = {
    "D02": "+", "D03": "+", "D07": ".", "D08": "(", "D09": "(", "D12": "HKhk\u212a", "D14": "-",
    "D30a": "-/", "D30b": "-/",
}
_CARD_LENGTH = r"(?U)\d(?:[\s-]?\d){12}"


def _hits(rules: list[Rule], text: str, needs: bool = False) -> str:
    """``array<struct<rule, entity, score, text>>``: the text as each rule marks it.

    Only rules that marked something stay.  The patterns are literals, so each is
    compiled once per task.  With ``needs`` a rule runs only on a text that holds
    the characters it cannot do without.
    """
    def marked_by(some: list[Rule]) -> str:
        parts = []
        for r in some:
            done = mark(text, r.inline, r.value_group)
            must = _MUST_HOLD.get(r.rule_id) if needs else None
            if must:
                holds = " OR ".join(f"contains({text}, '{c}')" for c in must)
                done = when(holds, done, text)
            parts.append(
                f"named_struct('rule', {quoted(r.rule_id)}, 'entity', {quoted(r.entity_type)}, "
                f"'score', {r.score}D, 'text', {done})")
        return f"array({', '.join(parts)})"

    cards = [r for r in rules if needs and r.entity_type == "CREDIT_CARD"]
    others = [r for r in rules if r not in cards]
    groups = [marked_by(others)] if others else []
    if cards:
        none = "CAST(array() AS array<struct<rule:string,entity:string,score:double,text:string>>)"
        groups.append(when(f"rlike({text}, {quoted(_CARD_LENGTH)})", marked_by(cards), none))
    every = groups[0] if len(groups) == 1 else f"concat({', '.join(groups)})"
    return each("filter", every, lambda h: marked(f"{h}.text"))


def _spans_of(hit: str, text: str, base: str) -> str:
    return each("transform", marked_values(text), lambda v: span(
        f"{base} + {v}.start", f"{base} + {v}.start + length({v}.value)",
        f"{hit}.entity", f"{hit}.score", f"{hit}.rule", f"{v}.value"))


def _whole_text(rules: list[Rule], text: str) -> str:
    spans = each("transform", _hits(rules, text), lambda h: _spans_of(h, f"{h}.text", "0"))
    return f"flatten({spans})"


def _digit_windows(text: str) -> str:
    """``array<struct<base, body>>``: digit runs with their surroundings."""
    def window(pieces: str, start: Callable[[str], str], i: str) -> str:
        behind = f"concat(coalesce(right(get({pieces}, {i} - 2), 1), ''), {pieces}[{i} - 1])"
        return let(f"right({behind}, {_BEFORE})", lambda before: (
            f"named_struct('base', {start(i)} - length({before}), 'body', "
            f"concat({before}, {pieces}[{i}], left({pieces}[{i} + 1], {_AFTER})))"))

    def cut(pieces: str) -> str:
        return with_starts(pieces, lambda start: at_odd(pieces, lambda i: window(pieces, start, i)))

    return let(mark(text, _RUN), lambda m: when(
        marked(m), let(f"split({m}, {quoted(MARK)})", cut), "NULL"))


def _digit_family(rules: list[Rule], text: str) -> str:
    def place(windows: str, hit: str) -> str:
        """Spans of one rule: its marked digest, cut back into the windows."""
        inside = when(marked("piece"), _spans_of(hit, "piece", "w.base"), empty())
        return f"flatten(zip_with({windows}, split({hit}.text, {quoted(CUT)}), (w, piece) -> {inside}))"

    def run_rules(windows: str, digest: str) -> str:
        spans = each("transform", _hits(rules, digest, needs=True), lambda h: place(windows, h))
        return _checked(f"flatten({spans})")

    return let(_digit_windows(text), lambda windows: when(
        f"{windows} IS NOT NULL",
        let(f"array_join(transform({windows}, w -> w.body), {quoted(CUT)})",
            lambda digest: run_rules(windows, digest)),
        empty(),
    ))


def _checked(spans: str) -> str:
    """Phones that read as dates go; cards lose inner matches, then face the checksum."""
    def outermost(run: str) -> str:
        def inner(x: str) -> str:
            return each("exists", run, lambda y: (
                f"({y}.start <= {x}.start AND {y}.end >= {x}.end AND "
                f"({y}.start < {x}.start OR {y}.end > {x}.end OR {y}.rule < {x}.rule))"))

        return each("filter", run, lambda x: f"NOT {inner(x)}")

    def split_cards(found: str) -> str:
        plain = each("filter", found, lambda s: (
            f"{s}.entity_type <> 'CREDIT_CARD' AND NOT "
            f"({s}.entity_type = 'PHONE_NUMBER' AND {checks.date_like(f'{s}.value')})"))
        cards = each("filter", found, lambda s: f"{s}.entity_type = 'CREDIT_CARD'")
        valid = each("filter", per_island(cards, outermost), lambda s: checks.luhn_ok(f"{s}.value"))
        scored = each("transform", valid, lambda s: span(
            f"{s}.start", f"{s}.end", f"{s}.entity_type", str(book.CARD_SCORE), f"{s}.rule", f"{s}.value"))
        return f"concat({plain}, {scored})"

    return let(spans, lambda found: when(f"size({found}) > 0", split_cards(found), found))


def _by_first_char(words: str) -> str:
    """The words as an alternation that reads each first character once."""
    tails: dict[str, list[str]] = {}
    for w in words.split("|"):
        tails.setdefault(w[0], []).append(w[1:])
    firsts = "".join(sorted(tails))
    return f"(?=[{firsts}])(?:" + "|".join(f"{c}(?:{'|'.join(t)})" for c, t in tails.items()) + ")"


_ZH_ENDS = "".join(
    sorted({w[-1] for w in f"{book.ZH_STREET}|{book.ZH_BUILDING}|{book.ZH_MACAU}|臺".split("|")})
)
_PT_WORDS = f"{book.PT_STREET}|{book.PT_BUILDING}"
_EN_GATE = f"(?<={_BLANK}){_by_first_char(book.EN_SUFFIX)}{book.RIGHT}"
_PT_GATE = f"{_by_first_char(f'{_PT_WORDS}|{_PT_WORDS.upper()}')}(?:[.]|{_BLANK})"

# Per family: a cheap condition without which it cannot match.
_GATES = {
    "email": lambda t: f"contains({t}, '@')",
    "zh": lambda t: f"rlike({t}, {quoted(f'[{_ZH_ENDS}]')})",
    "form": lambda t: f"rlike({t}, '[：:]')",
    "en": lambda t: f"rlike({t}, {quoted(f'(?=[A-Z]){_EN_GATE}')})",
    "pt": lambda t: f"rlike({t}, {quoted(_PT_GATE)})",
}


def _wide(text: str) -> str:
    """Holds a Han character.  The byte count alone rules out most texts."""
    return f"(octet_length({text}) > length({text}) + 1 AND rlike({text}, {quoted(_HAN)}))"


def raw_spans(text: str, rules: list[Rule]) -> str:
    """Spans of ``rules`` in ``text`` (``SPAN_TYPE``), before overlaps are resolved."""
    families: dict[str, list[Rule]] = {}
    for rule in rules:
        families.setdefault(rule.family, []).append(rule)

    def run(t: str) -> str:
        parts, han, latin = [empty()], [empty()], [empty()]
        for family, members in families.items():
            if family == "digits":
                parts.append(_digit_family(members, t))
                continue
            group = {"zh": han, "form": han, "en": latin, "pt": latin}.get(family, parts)
            group.append(when(_GATES[family](t), _whole_text(members, t), empty()))
        if len(han) > 1:
            parts.append(when(_wide(t), f"concat({', '.join(han)})", empty()))
        if len(latin) > 1:
            either = f"rlike({t}, {quoted(f'(?=[A-Z])(?:{_EN_GATE}|{_PT_GATE})')})"
            parts.append(when(either, f"concat({', '.join(latin)})", empty()))
        return f"concat({', '.join(parts)})"

    # Values are read back from the text itself where markers were swapped.
    def exact(found: str) -> str:
        own = each("transform", found, lambda s: span(
            f"{s}.start", f"{s}.end", f"{s}.entity_type", f"{s}.score", f"{s}.rule",
            slice_of(text, f"{s}.start", f"{s}.end")))
        return when(f"size({found}) > 0 AND {has_marks(text)}", own, found)

    found = let(let(without_marks(text), run), exact)
    return when(f"{text} IS NULL OR trim({text}) = ''", empty(), found)

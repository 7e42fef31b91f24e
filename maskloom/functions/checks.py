"""Predicates over a matched value, as Spark SQL fragments."""

from __future__ import annotations

from maskloom.functions import rulebook as book
from maskloom.functions.text import quoted, strings


def luhn_ok(value: str) -> str:
    """Thirteen digits or more, and the checksum holds; separators are ignored."""
    plain = f"translate({value}, '０１２３４５６７８９', '0123456789')"
    digits = f"regexp_replace({plain}, {quoted(chr(92) + 'P{Nd}')}, '')"
    return f"(length({digits}) >= 13 AND luhn_check({digits}))"


def date_like(value: str) -> str:
    """An eight-digit number that reads as YYYYMMDD."""
    return f"rlike({value}, {quoted('(?U)' + book.DATE_LIKE)})"


def has_cjk(value: str) -> str:
    return f"rlike({value}, {quoted(book.CJK_OR_PUNCT)})"


def is_stop_word(value: str) -> str:
    """One plain ASCII word from the list of words that are never names."""
    plain = quoted(r"^[A-Za-z]+\z")
    return f"(rlike({value}, {plain}) AND array_contains({strings(book.NOT_A_NAME)}, lower({value})))"


def digits_only(value: str) -> str:
    return f"rlike({value}, {quoted('(?U)' + book.DIGITS_ONLY)})"


def address_prefix(value: str) -> str:
    """Opens with a Portuguese street or building word."""
    return f"rlike({value}, {quoted(f'(?iU)^(?:{book.PT_PREFIX_NOT_NAME})' + chr(92) + 'b')})"


def name_punctuation(value: str) -> str:
    return f"rlike({value}, {quoted(book.NAME_PUNCTUATION)})"


def overlap(a: str, b: str) -> str:
    return f"({a}.start < {b}.end AND {b}.start < {a}.end)"

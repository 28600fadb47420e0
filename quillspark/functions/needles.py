"""What any match of a pattern must hold, so that texts without it need no pattern.

Looking for a string is many times as fast as a pattern without case, and so is one pass of an
automaton for a wider pattern (``likely``). The pattern itself still decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from re import IGNORECASE, PatternError, _constants as op, _parser, search

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Shorter strings are in most texts.
LEAST = 3


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    rank = lambda x: (min(map(len, x)), -len(x))
    return max((x for x in (a, b) if x), key=rank, default=None)


def _need(items) -> frozenset | None:
    best, run = None, ""
    for kind, arg in [*items, (None, None)]:
        if kind is op.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        best, run = _better(best, frozenset({run}) if len(run) >= LEAST else None), ""
        if kind is op.SUBPATTERN:
            best = _better(best, _need(arg[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            best = _better(best, _need(arg[2]))
        elif kind is op.BRANCH:
            each = [_need(x) for x in arg[1]]
            best = _better(best, frozenset().union(*each) if all(each) else None)
    return best


def needles(pattern: str) -> tuple[str, ...]:
    """Strings in lower case of which every match holds one; none if there is no such set."""
    return tuple(sorted(_need(_parser.parse(pattern)) or ()))


def folded(text: Column) -> Column:
    """The text in which needles are looked for: small letters, and those that count as s and i without case."""
    return F.translate(F.lower(text), "ſı", "si")


def may_match(low: Column, pattern: str) -> Column:
    """False only where the pattern can't match the text that ``low`` was made from."""
    found = needles(pattern)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in found]) if found else F.lit(True)


#: Any byte, and letters beyond ASCII that count as ASCII ones without case.
_ANY = r"(?s:.)"
_ALIKE = {"i": r"\xc4[\xb0\xb1]", "k": r"\xe2\x84\xaa", "s": r"\xc5\xbf"}
#: White space, also beyond ASCII.
_BLANK = r"(?:[\x09-\x0d\x1c-\x20]|[\x80-\xff]{1,3})"
#: Longer counted repeats only make the automaton larger; least ones that are longer say something.
_REPEAT, _LEAST_REPEAT = 4, 16
_BITS = 62


def _bytes(codes: Iterable[int], fold: bool) -> str:
    """One character of those, as bytes; those beyond ASCII are any byte."""
    codes = set(codes)
    if any(c > 127 for c in codes):
        return _ANY
    if fold:
        codes |= {ord(x) for c in codes for x in (chr(c).lower(), chr(c).upper())}
    own = "[" + "".join(rf"\x{c:02x}" for c in sorted(codes)) + "]"
    alike = [x for c, x in _ALIKE.items() if fold and ord(c) in codes]
    return f"(?:{'|'.join([own, *alike])})" if alike else own


def _wider(items, fold: bool) -> str:
    out = ""
    for kind, arg in items:
        if kind is op.LITERAL:
            out += _bytes([arg], fold)
        elif kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in arg):
            out += _bytes([c for k, x in arg for c in ([x] if k is op.LITERAL else range(x[0], min(x[1], 128) + 1))], fold)
        elif kind is op.IN and list(arg) == [(op.CATEGORY, op.CATEGORY_SPACE)]:
            out += _BLANK
        elif kind in (op.IN, op.ANY, op.NOT_LITERAL, op.CATEGORY):
            out += _ANY
        elif kind is op.SUBPATTERN:
            out += f"(?:{_wider(arg[3], (fold or bool(arg[1] & IGNORECASE)) and not arg[2] & IGNORECASE)})"
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = arg
            out += f"(?:{_wider(inner, fold)}){{{min(least, _LEAST_REPEAT)},{most if most <= max(least, _REPEAT) and most <= _LEAST_REPEAT else ''}}}"
        elif kind is op.ATOMIC_GROUP:
            out += f"(?:{_wider(arg, fold)})"
        elif kind is op.BRANCH:
            out += "(?:" + "|".join(_wider(x, fold) for x in arg[1]) + ")"
        elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):  # those hold no characters; what isn't known may be anything
            out += f"{_ANY}*"
    return out


@lru_cache(maxsize=None)
def wider(pattern: str) -> str:
    """A pattern of bytes for linear automata that finds something in every text where ``pattern`` does; empty if there is none.

    Anchors, looks around and back, and classes beyond ASCII are let go. What may be missing at either end is left out.
    """
    if search(r"&&|(?<!\\)\[[^\]]*(?<!\\)\[", pattern):  # classes within classes, which Python reads otherwise
        return ""
    try:
        parsed = _parser.parse(pattern)
    except PatternError:
        return ""
    items = list(parsed)
    while items and _optional(items[0]):
        items.pop(0)
    while items and _optional(items[-1]):
        items.pop()
    return _wider(items, bool(parsed.state.flags & IGNORECASE))


def _optional(item) -> bool:
    """Whether an item may match without a character."""
    kind, arg = item
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        return arg[0] == 0
    if kind is op.SUBPATTERN:
        return all(_optional(x) for x in arg[3])
    if kind is op.BRANCH:
        return any(all(_optional(x) for x in branch) for branch in arg[1])
    return kind in (op.AT, op.ASSERT, op.ASSERT_NOT)


@lru_cache(maxsize=None)
def _finder(patterns: tuple[str, ...]):
    @F.arrow_udf(ArrayType(LongType()))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            words = []
            for at in range(0, len(patterns), _BITS):
                word = None
                for k, pattern in enumerate(patterns[at : at + _BITS]):
                    hit = pc.match_substring_regex(texts, pattern) if pattern else pa.scalar(True)
                    bit = pc.if_else(pc.fill_null(hit, False), pa.scalar(1 << k, pa.int64()), pa.scalar(0, pa.int64()))
                    word = bit if word is None else pc.bit_wise_or(word, bit)
                words.append(word if isinstance(word, pa.Array) else pa.array([word.as_py()] * len(texts), pa.int64()))
            n = len(words)
            flat = pc.take(pa.concat_arrays(words), pa.array([w * len(texts) + k for k in range(len(texts)) for w in range(n)], pa.int64()))
            yield pa.ListArray.from_arrays(pa.array(range(0, n * len(texts) + 1, n), pa.int32()), flat)

    return find


def likely(text: Column, patterns: Iterable[str]) -> Column:
    """What ``is_likely`` asks: which of the patterns may match a text, from one look of an automaton at its bytes for each."""
    return _finder(tuple(wider(p) for p in patterns))(text.cast("binary"))


def is_likely(found: Column, k: int) -> Column:
    """False only where the kth pattern can't match the text that ``found`` was made from."""
    return F.coalesce(F.get(found, F.lit(k // _BITS)).bitwiseAND(F.lit(1 << k % _BITS)) != 0, F.lit(False))


def any_likely(found: Column) -> Column:
    """False only where none of the patterns can match."""
    return F.coalesce(F.exists(found, lambda x: x != 0), F.lit(False))

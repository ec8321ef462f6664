"""ECMAScript regex semantics on Java (Spark) and RE2 (SQL checks).

Detector patterns are authored with ECMAScript meaning.  Java differs in word
boundaries, whitespace, ``.``, ``$``, class nesting and case folding, so a
pattern is parsed once with Python's own regex parser (driver side, plan build
time) and written out again with explicit classes:

* ``java()``    - the text handed to ``rlike`` / ``regexp_extract`` / ``regexp_replace``
* ``re2()``     - the equivalent for an RE2 engine; look-around guards consume
                  one character there, so the wanted span is capture group 1
* ``anchors()`` - lower-case literals one of which every match must contain;
                  looking for all of them at once is far cheaper than running
                  every regex
"""

from __future__ import annotations

import functools
import re
import warnings
from dataclasses import dataclass
from typing import NamedTuple

# The stdlib regex parser; only syntax trees are read from it, on the driver.
from re import _constants as sre
from re import _parser as sre_parser

# ECMAScript WhiteSpace + LineTerminator and LineTerminator code points (fixed values).
_SPACE = [(9, 13), (32, 32), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
          (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
_LINE_ENDS = [(10, 10), (13, 13), (0x2028, 0x2029)]
_DIGIT = [(48, 57)]
_WORD = [(48, 57), (65, 90), (95, 95), (97, 122)]
_MAX_CP = 0x10FFFF
_MAX_REPEAT = sre_parser.MAXREPEAT


class Anchor(NamedTuple):
    """A literal of the lower-cased text, with word edges it must sit on."""

    literal: str
    left: bool = False
    right: bool = False


class PatternError(ValueError):
    """The pattern cannot be expressed with the reference meaning."""


def _js_upper(ch: str) -> str:
    up = ch.upper()
    if len(up) != 1 or (ord(ch) > 127 and ord(up) < 128):
        return ch
    return up


@functools.cache
def _fold_table() -> dict[str, tuple[str, ...]]:
    groups: dict[str, list[str]] = {}
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        groups.setdefault(_js_upper(ch), []).append(ch)
    return {c: tuple(g) for g in groups.values() if len(g) > 1 for c in g}


def _partners(ch: str) -> tuple[str, ...]:
    """Characters an ECMAScript ``i`` pattern treats as equal to ``ch``."""
    return _fold_table().get(ch, (ch,))


def _complement(ranges):
    out, pos = [], 0
    for lo, hi in _merge(ranges):
        if lo > pos:
            out.append((pos, lo - 1))
        pos = hi + 1
    if pos <= _MAX_CP:
        out.append((pos, _MAX_CP))
    return out


def _merge(ranges):
    out = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


_CATEGORY = {
    sre.CATEGORY_DIGIT: _DIGIT,
    sre.CATEGORY_NOT_DIGIT: _complement(_DIGIT),
    sre.CATEGORY_SPACE: _SPACE,
    sre.CATEGORY_NOT_SPACE: _complement(_SPACE),
    sre.CATEGORY_WORD: _WORD,
    sre.CATEGORY_NOT_WORD: _complement(_WORD),
}


def _class_ranges(items, ignore_case):
    """(negated, code point ranges) of a bracket expression."""
    negated, ranges = False, []
    for op, arg in items:
        if op is sre.NEGATE:
            negated = True
        elif op is sre.LITERAL:
            ranges.append((arg, arg))
        elif op is sre.RANGE:
            ranges.append(tuple(arg))
        elif op is sre.CATEGORY:
            ranges.extend(_CATEGORY[arg])
        else:
            raise PatternError(f"unsupported class member {op}")
    if ignore_case:
        # Whatever its width, a range brings in the partners of the characters in it.
        extra = [ord(p) for ch, same in _fold_table().items() if any(lo <= ord(ch) <= hi for lo, hi in ranges) for p in same]
        ranges = ranges + [(c, c) for c in extra]
    return negated, _merge(ranges)


@dataclass(frozen=True)
class Pattern:
    """One ECMAScript pattern: source text plus flags out of ``gimsuy``."""

    source: str
    flags: str = ""

    @functools.cached_property
    def _tree(self):
        if re.search(r"\\[pPk]|\(\?<[A-Za-z]|\(\?P", self.source):
            raise PatternError("named groups and property classes are not supported")
        py_flags = 0
        for letter, flag in (("i", re.I), ("m", re.M), ("s", re.S)):
            if letter in self.flags:
                py_flags |= flag
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = sre_parser.parse(self.source, py_flags)
        except (re.error, OverflowError, RecursionError) as exc:
            raise PatternError(str(exc)) from exc
        if tree.state.flags & (re.X | re.A | re.L):
            raise PatternError("unsupported inline flag")
        return tree

    @property
    def ignore_case(self) -> bool:
        return bool(self._tree.state.flags & re.I)

    @property
    def _dot_all(self) -> bool:
        return bool(self._tree.state.flags & re.S)

    @property
    def _multiline(self) -> bool:
        return bool(self._tree.state.flags & re.M)

    @functools.cached_property
    def can_be_empty(self) -> bool:
        return self._tree.getwidth()[0] == 0

    @functools.cached_property
    def _java(self) -> str:
        head = "(?i)" if self.ignore_case else ""
        sticky = r"\A" if "y" in self.flags else ""
        return head + sticky + _Writer(self, re2=False).seq(self._tree)

    def java(self) -> str:
        return self._java

    @functools.cached_property
    def _re2(self) -> tuple[str, int]:
        items = list(self._tree)
        head = "(?i)" if self.ignore_case else ""
        w = _Writer(self, re2=True)
        before = after = ""
        if items and items[0][0] is sre.ASSERT_NOT and items[0][1][0] < 0:
            before = "(?:^|" + w.not_class(items.pop(0)[1][1]) + ")"
        if items and items[-1][0] is sre.ASSERT_NOT and items[-1][1][0] > 0:
            after = r"(?:\z|" + w.not_class(items.pop()[1][1]) + ")"
        body = w.seq(items)
        if not before and not after:
            return head + body, 0
        return f"{head}{before}({body}){after}", 1

    def re2(self) -> str:
        return self._re2[0]

    def re2_group(self) -> int:
        return self._re2[1]

    @functools.cached_property
    def _anchors(self) -> tuple[Anchor, ...] | None:
        best = _required(self._tree, self.ignore_case)
        return tuple(sorted({_anchor(t) for t in best})) if best else None

    def anchors(self) -> tuple[Anchor, ...] | None:
        return self._anchors

    @functools.cached_property
    def min_width(self) -> int:
        return self._tree.getwidth()[0]

    def can_hold(self, chars: str) -> bool:
        """May a match hold one of ``chars``?"""
        return _consumes(self._tree, [ord(c) for c in chars])

    @functools.cached_property
    def min_digits(self) -> int:
        """ASCII digits every match holds at least."""
        return _digits(self._tree)


class _Writer:
    def __init__(self, pattern: Pattern, re2: bool):
        self.p, self.re2 = pattern, re2

    # -- characters -------------------------------------------------------
    def char(self, cp: int) -> str:
        if 48 <= cp <= 57 or 65 <= cp <= 90 or 97 <= cp <= 122 or cp == 95:
            return chr(cp)
        if cp < 32 or cp == 127:
            return f"\\x{{{cp:x}}}" if self.re2 else f"\\x{cp:02x}"
        if cp < 128:
            return chr(cp) if chr(cp) in " @:;,/<>=~`'\"%#!" else "\\" + chr(cp)
        if cp in (0x2028, 0x2029, 0xFEFF, 0xA0, _MAX_CP) or 0x2000 <= cp <= 0x200A or cp > 0xFFFF:
            return f"\\x{{{cp:x}}}"
        return chr(cp)

    def ranges(self, ranges, negated=False) -> str:
        body = "".join(self.char(lo) if lo == hi else f"{self.char(lo)}-{self.char(hi)}" for lo, hi in ranges)
        return f"[{'^' if negated else ''}{body}]"

    def literal(self, cp: int) -> str:
        if self.p.ignore_case and cp > 127:
            same = _partners(chr(cp))
            if len(same) > 1:
                return self.ranges(_merge([(ord(c), ord(c)) for c in same]))
        return self.char(cp)

    def klass(self, items) -> str:
        if len(items) == 1 and items[0][0] is sre.CATEGORY:
            short = {sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_NOT_DIGIT: r"\D",
                     sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W"}.get(items[0][1])
            if short:
                return short
        negated, ranges = _class_ranges(items, self.p.ignore_case)
        return self.ranges(ranges, negated)

    def not_class(self, items) -> str:
        items = list(items)
        if len(items) != 1 or items[0][0] is not sre.IN:
            raise PatternError("guard is not a single class")
        negated, ranges = _class_ranges(items[0][1], self.p.ignore_case)
        return self.ranges(ranges, not negated)

    # -- structure --------------------------------------------------------
    def seq(self, items) -> str:
        items = list(items)
        return "".join(self.item(items, i) for i in range(len(items)))

    def atom(self, items) -> str:
        items = list(items)
        text = self.seq(items)
        if len(items) == 1 and items[0][0] in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY, sre.SUBPATTERN):
            return text
        return f"(?:{text})"

    def item(self, items, i) -> str:
        op, arg = items[i]
        if op is sre.LITERAL:
            return self.literal(arg)
        if op is sre.NOT_LITERAL:
            return self.klass([(sre.NEGATE, None), (sre.LITERAL, arg)])
        if op is sre.ANY:
            return "(?s:.)" if self.p._dot_all else self.ranges(_LINE_ENDS, True)
        if op is sre.IN:
            return self.klass(arg)
        if op is sre.BRANCH:
            return "(?:" + "|".join(self.seq(b) for b in arg[1]) + ")"
        if op is sre.SUBPATTERN:
            group, add, drop, body = arg
            if add or drop:
                raise PatternError("scoped inline flags are not supported")
            text = self.seq(body)
            return f"({text})" if group is not None and self._backrefs() else f"(?:{text})"
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            lo, hi, body = arg
            return self.atom(body) + _quantifier(lo, hi) + ("?" if op is sre.MIN_REPEAT else "")
        if op is sre.AT:
            return self.at(arg, items, i)
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            if self.re2:
                raise PatternError("look-around inside an RE2 pattern")
            direction, body = arg
            sign = "=" if op is sre.ASSERT else "!"
            return f"(?{'<' if direction < 0 else ''}{sign}{self.seq(body)})"
        if op is sre.GROUPREF and not self.re2:
            return f"\\{arg}"
        raise PatternError(f"unsupported construct {op}")

    @functools.cached_property
    def _has_backrefs(self) -> bool:
        return bool(re.search(r"\\[1-9]", self.p.source))

    def _backrefs(self) -> bool:
        return self._has_backrefs

    def at(self, where, items, i) -> str:
        if where is sre.AT_BEGINNING:
            return "(?m:^)" if self.p._multiline else (r"\A")
        if where is sre.AT_END:
            return (r"(?m:$)" if self.re2 else r"(?=[\n\r\x{2028}\x{2029}]|\z)") if self.p._multiline else r"\z"
        if where is sre.AT_BOUNDARY:
            if self.re2:
                return r"\b"
            # A boundary next to a character known to be a word character needs
            # only one side tested.
            if _all_word(items[i + 1:], first=True):
                return r"(?<!\w)"
            if _all_word(items[:i], first=False):
                return r"(?!\w)"
            return r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        if where is sre.AT_NON_BOUNDARY:
            return r"\B" if self.re2 else r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
        raise PatternError(f"unsupported position {where}")


def _quantifier(lo, hi) -> str:
    if (lo, hi) == (0, 1):
        return "?"
    if hi is _MAX_REPEAT or hi == _MAX_REPEAT:
        return "*" if lo == 0 else "+" if lo == 1 else f"{{{lo},}}"
    return f"{{{lo}}}" if lo == hi else f"{{{lo},{hi}}}"


def _all_word(items, first: bool) -> bool:
    """Does the sequence always start (or end) with an ASCII word character?"""
    items = list(items)
    if not items:
        return False
    op, arg = items[0] if first else items[-1]
    if op is sre.LITERAL:
        return any(lo <= arg <= hi for lo, hi in _WORD)
    if op is sre.IN:
        negated, ranges = _class_ranges(arg, False)
        return not negated and all(any(a <= lo and hi <= b for a, b in _WORD) for lo, hi in ranges)
    if op is sre.SUBPATTERN:
        return _all_word(arg[3], first)
    if op is sre.BRANCH:
        return all(_all_word(b, first) for b in arg[1])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        return arg[0] > 0 and _all_word(arg[2], first)
    if op is sre.AT and arg is sre.AT_BOUNDARY:
        return _all_word(items[1:] if first else items[:-1], first)
    return False


def _consumes(items, chars) -> bool:
    """May a match hold one of ``chars``?"""
    for op, arg in items:
        if op is sre.LITERAL:
            hit = arg in chars
        elif op is sre.NOT_LITERAL:
            hit = any(c != arg for c in chars)
        elif op is sre.ANY:
            hit = True
        elif op is sre.IN:
            negated, ranges = _class_ranges(arg, False)
            hit = any(negated != any(lo <= c <= hi for lo, hi in ranges) for c in chars)
        elif op is sre.BRANCH:
            hit = any(_consumes(b, chars) for b in arg[1])
        elif op is sre.SUBPATTERN:
            hit = _consumes(arg[3], chars)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            hit = _consumes(arg[2], chars)
        else:
            hit = op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT)
        if hit:
            return True
    return False


def _digits(items) -> int:
    total = 0
    for op, arg in items:
        if op is sre.LITERAL:
            total += 48 <= arg <= 57
        elif op is sre.IN:
            negated, ranges = _class_ranges(arg, False)
            total += not negated and all(48 <= lo and hi <= 57 for lo, hi in ranges)
        elif op is sre.BRANCH:
            total += min(_digits(b) for b in arg[1])
        elif op is sre.SUBPATTERN:
            total += _digits(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            total += arg[0] * _digits(arg[2])
    return total


# -- literals every match must contain -------------------------------------

_RUN_LIMIT = 24  # alternatives carried while joining neighbouring literals


def _lower(cp: int, ignore_case: bool) -> str | None:
    ch = chr(cp)
    same = _partners(ch) if ignore_case else (ch,)
    lows = {c.lower() for c in same}
    return lows.pop() if len(lows) == 1 and len(min(lows, default=ch) if lows else ch) == 1 else None


def _alternatives(item, ignore_case) -> set[str] | None:
    """Every exact lower-case text the item can match, when they are few."""
    op, arg = item
    if op is sre.LITERAL:
        low = _lower(arg, ignore_case)
        return {low} if low is not None else None
    if op is sre.IN:
        negated, ranges = _class_ranges(arg, False)
        if negated or sum(hi - lo + 1 for lo, hi in ranges) > 6:
            return None
        lows = {_lower(cp, ignore_case) for lo, hi in ranges for cp in range(lo, hi + 1)}
        return None if None in lows else lows
    if op is sre.BRANCH:
        out: set[str] = set()
        for branch in arg[1]:
            texts = _sequence_texts(branch, ignore_case)
            if texts is None:
                return None
            out |= texts
        return out if len(out) <= _RUN_LIMIT else None
    if op is sre.SUBPATTERN:
        return _sequence_texts(arg[3], ignore_case)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        lo, hi, body = arg
        if (lo, hi) == (0, 1):
            inner = _sequence_texts(body, ignore_case)
            return None if inner is None else inner | {""}
        if lo == hi == 1:
            return _sequence_texts(body, ignore_case)
    if op is sre.AT:
        return {_EDGE} if arg is sre.AT_BOUNDARY else {""}
    return None


def _sequence_texts(items, ignore_case) -> set[str] | None:
    out = {""}
    for item in items:
        alt = _alternatives(item, ignore_case)
        if alt is None:
            return None
        out = {a + b for a in out for b in alt}
        if len(out) > _RUN_LIMIT:
            return None
    return out


_EDGE = "\0"  # a word boundary inside an alternative
_EVERYDAY = frozenset("the you your this that when once after are and all for not with have from".split())


def _anchor(text: str) -> Anchor:
    literal = text.replace(_EDGE, "")
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    return Anchor(literal, text.startswith(_EDGE) and word(literal[0]), text.endswith(_EDGE) and word(literal[-1]))


def _frequency(text: str) -> float:
    """Rough chance that a literal turns up at a position of ordinary text."""
    a = _anchor(text)
    if a.literal in _EVERYDAY:
        return 0.05
    if len(a.literal) == 1:
        return 1e-3 if a.literal in "@`" else 0.1
    edges = 0.2 if a.left and a.right else 0.5 if a.left or a.right else 1.0
    return edges * 15.0 ** -len(a.literal)


_TOO_COMMON = 0.01


def _score(texts: set[str]) -> float:
    return -sum(map(_frequency, texts))


def _reduce(texts: set[str]) -> set[str]:
    """Drop a literal that contains another one: finding the shorter suffices."""
    return {t for t in texts if not any(o != t and o in t for o in texts)}


def _required(items, ignore_case) -> set[str] | None:
    candidates: list[set[str]] = []
    run: set[str] = {""}

    def usable(texts):
        return all(t.replace(_EDGE, "") for t in texts)

    def flush():
        nonlocal run
        if usable(run):
            candidates.append(_reduce(run))
        run = {""}

    for item in items:
        alt = _alternatives(item, ignore_case)
        if alt is not None and len(run) * len(alt) <= _RUN_LIMIT:
            if "" in alt and len(alt) > 1:
                # the run so far is required whichever way the option goes
                if usable(run):
                    candidates.append(_reduce(run))
            run = {a + b for a in run for b in alt}
            continue
        flush()
        if alt is not None:
            run = alt
            continue
        op, arg = item
        if op is sre.BRANCH:
            parts = [_required(b, ignore_case) for b in arg[1]]
            if all(parts):
                candidates.append(_reduce(set().union(*parts)))
        elif op is sre.SUBPATTERN:
            inner = _required(arg[3], ignore_case)
            if inner:
                candidates.append(inner)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            inner = _required(arg[2], ignore_case)
            if inner:
                candidates.append(inner)
            # What follows a repetition follows its last round.
            last = _sequence_texts(arg[2], ignore_case)
            if last is not None and all(last):
                run = last
    flush()
    candidates = [c for c in candidates if c and usable(c)]
    if not candidates:
        return None
    best = max(candidates, key=_score)
    return best if -_score(best) < _TOO_COMMON else None

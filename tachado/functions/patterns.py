"""Rule patterns: from the ``re`` dialect users write to the JVM's.

Rules are written for Python's ``re``.  Spark's regular expression functions run
``java.util.regex``, where ``\\w``, ``\\d``, ``\\s``, ``\\b``, ``.`` and ``$`` mean
something else for non-ASCII text (and ``\\b`` differs between JDKs).  ``to_jvm``
re-states a pattern with explicit classes and look-arounds so both find the same
spans; a pattern it cannot re-state exactly is left to the Arrow branch of
``detect``.  The patterns are few and this runs once per pattern, never per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as sre, _parser
except ImportError:  # Python < 3.11
    import sre_constants as sre
    import sre_parse as _parser

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
# Keyed by name: the parser's own constants cannot travel to a worker.
_CLASS = {
    "CATEGORY_DIGIT": DIGIT, "CATEGORY_WORD": WORD, "CATEGORY_SPACE": SPACE,
    "CATEGORY_NOT_DIGIT": f"[^{DIGIT}]", "CATEGORY_NOT_WORD": f"[^{WORD}]", "CATEGORY_NOT_SPACE": f"[^{SPACE}]",
}
_ONE_CHAR = ("LITERAL", "NOT_LITERAL", "ANY", "IN")


class NotTranslatable(Exception):
    """The pattern uses something with no exact JVM counterpart here."""


@dataclass(frozen=True)
class JvmPattern:
    pattern: str            # for rlike / regexp_extract_all / split, group 0
    required: tuple         # literals every match contains (cheap pre-check)
    digit_run: int          # digits in a row every match contains (pre-check shared by rules)


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() and c.isascii() else f"\\x{{{code:x}}}"


def _members(items) -> str:
    """The inside of a character class."""
    out = []
    for op, av in items:
        if op is sre.LITERAL:
            out.append(_char(av))
        elif op is sre.RANGE:
            out.append(f"{_char(av[0])}-{_char(av[1])}")
        elif op is sre.CATEGORY:
            out.append(_CLASS[str(av)])
        else:
            raise NotTranslatable(str(op))
    return "".join(out)


def _one_char(item):
    """Class body if the item matches exactly one character of a known set."""
    op, av = item
    if op is sre.LITERAL:
        return _char(av)
    if op is sre.IN and av[0][0] is not sre.NEGATE:
        return _members(av)
    return None


def _is_word_class(item) -> bool:
    op, av = item
    def word(code):
        return chr(code).isalnum() or code == ord("_")
    if op is sre.LITERAL:
        return word(av)
    if op is not sre.IN:
        return False
    for kind, v in av:
        if kind is sre.LITERAL and word(v):
            continue
        if kind is sre.RANGE and v[1] < 128 and all(word(c) for c in range(v[0], v[1] + 1)):
            continue
        if kind is sre.CATEGORY and v in (sre.CATEGORY_DIGIT, sre.CATEGORY_WORD):
            continue
        return False
    return True


def _edge(items, last: bool):
    """The character item at the start (or end) of a sequence, if it is certain."""
    if not items:
        return None
    op, av = items[-1 if last else 0]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        return _edge(list(av[2]), last) if av[0] > 0 else None
    if op is sre.SUBPATTERN:
        return _edge(list(av[3]), last)
    return (op, av)


def _first(items):
    """(class body of possible first characters, can the sequence be empty)."""
    body = ""
    for op, av in items:
        one = _one_char((op, av))
        if one is not None:
            return body + one, False
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            inner, empty = _first(list(av[2]))
            empty = empty or av[0] == 0
        elif op is sre.SUBPATTERN:
            inner, empty = _first(list(av[3]))
        elif op is sre.BRANCH:
            parts = [_first(list(b)) for b in av[1]]
            if any(p[0] is None for p in parts):
                return None, True
            inner, empty = "".join(p[0] for p in parts), any(p[1] for p in parts)
        else:
            return None, True
        if inner is None:
            return None, True
        body += inner
        if not empty:
            return body, False
    return body, True


def _emit(items) -> str:
    out = []
    for i, (op, av) in enumerate(items):
        if op is sre.LITERAL:
            out.append(_char(av))
        elif op is sre.NOT_LITERAL:
            out.append(f"[^{_char(av)}]")
        elif op is sre.ANY:
            out.append(r"[^\n]")
        elif op is sre.IN:
            if av[0][0] is sre.NEGATE:
                out.append(f"[^{_members(av[1:])}]")
            else:
                out.append(f"[{_members(av)}]")
        elif op is sre.BRANCH:
            out.append("(?:" + "|".join(_emit(list(b)) for b in av[1]) + ")")
        elif op is sre.SUBPATTERN:
            if av[1] or av[2]:
                raise NotTranslatable("inline flags")
            out.append("(?:" + _emit(list(av[3])) + ")")
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = av
            top = "" if high is sre.MAXREPEAT else str(high)
            lazy = "?" if op is sre.MIN_REPEAT else ""
            body, single = _emit(list(sub)), len(sub) == 1 and str(sub[0][0]) in _ONE_CHAR
            out.append((body if single else f"(?:{body})") + f"{{{low},{top}}}{lazy}")
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            sign = "=" if op is sre.ASSERT else "!"
            behind = "<" if av[0] < 0 else ""
            out.append(f"(?{behind}{sign}{_emit(list(av[1]))})")
        elif op is sre.AT:
            if av is sre.AT_BEGINNING or av is sre.AT_BEGINNING_STRING:
                out.append(r"\A")
            elif av is sre.AT_END:
                out.append(r"(?=\n?\z)")
            elif av is sre.AT_END_STRING:
                out.append(r"\z")
            elif av is sre.AT_BOUNDARY:
                after = _edge(items[i + 1:], last=False)
                before = _edge(items[:i], last=True)
                if after is not None and _is_word_class(after):
                    out.append(f"(?<![{WORD}])")
                elif before is not None and _is_word_class(before):
                    out.append(f"(?![{WORD}])")
                else:
                    out.append(f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))")
            elif av is sre.AT_NON_BOUNDARY:
                out.append(f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))")
            else:
                raise NotTranslatable(str(av))
        else:
            raise NotTranslatable(str(op))
    return "".join(out)


def _required(items) -> list[str]:
    """Literals every match contains; blanks and dots say too little to be worth a look."""
    found, run = [], ""
    for op, av in list(items) + [(None, None)]:
        if op is sre.LITERAL:
            run += chr(av)
            continue
        if run.strip(" ."):
            found.append(run)
        run = ""
        if op is sre.SUBPATTERN:
            found += _required(list(av[3]))
    return found


def _digit_run(items) -> int:
    """Length of a run of digits that every match is sure to contain."""
    best = 0
    for op, av in items:
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[0] > 0:
            digit = list(av[2]) == [(sre.IN, [(sre.CATEGORY, sre.CATEGORY_DIGIT)])]
            best = max(best, av[0] if digit else _digit_run(list(av[2])))
        elif op is sre.SUBPATTERN:
            best = max(best, _digit_run(list(av[3])))
    return best


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except (re.error, RecursionError, OverflowError):
        return False


def matches_nothing(pattern: str) -> bool:
    """True if the pattern can match the empty string."""
    return _parser.parse(pattern).getwidth()[0] == 0


def to_jvm(pattern: str) -> JvmPattern | None:
    """The JVM form of a ``re`` pattern, or None if it has no exact one."""
    try:
        tree = _parser.parse(pattern)
        if tree.state.flags & ~re.UNICODE:
            return None
        items = list(tree)
        body = _emit(items)
        first, empty = _first(items)
    except (NotTranslatable, KeyError):
        return None
    # Testing the first character before any look-behind keeps the scan cheap.
    if first and not empty:
        body = f"(?=[{first}]){body}"
    return JvmPattern(body, tuple(_required(items)), _digit_run(items))

"""Texts found again in the words of a page: many at once, inside the row that holds the page.

A text may be spelled with other accents, blanks, dashes or line breaks.  Both sides are normalised, which leaves no
blanks; the page's words are laid end to end, and a text is spelled wherever its letters stand there from the start of
a word on, free to end inside one.  All texts of a page are looked for in one walk, by an automaton over them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from itertools import accumulate

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from tachado.functions.text import normalized

_INT, _TEXT = T.IntegerType(), T.StringType()


class _Normals(dict):
    """Normalised words, kept for those seen first."""

    def __missing__(self, word: str) -> str:
        value = normalized(word)
        if len(self) < 1 << 16:
            self[word] = value
        return value


_NORMALS = _Normals()


def _struct(*fields: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(f, _INT) for f in fields]))


def automaton(texts: Iterable[str]) -> ahocorasick.Automaton | None:
    """One that yields each of the texts (none of them empty) wherever it ends; None if there is no text."""
    made = ahocorasick.Automaton()
    for text in texts:
        made.add_word(text, text)
    if not len(made):
        return None
    made.make_automaton()
    return made


#: Between words that are normalised at once; nothing else becomes it.
_BETWEEN = "\0"


class LaidWords:
    """Normalised words end to end, with where each begins; one of which nothing is left begins where the next does."""

    def __init__(self, words: Iterable[str | None]):
        listed = [w or "" for w in words]
        parts = normalized(_BETWEEN.join(listed)).split(_BETWEEN)
        if len(parts) != len(listed):
            parts = [normalized(w) for w in listed]
        self.starts = list(accumulate(map(len, parts), initial=0))[:-1]
        self.text = "".join(parts)

    def begins(self, at: int) -> bool:
        place = bisect_left(self.starts, at)
        return place < len(self.starts) and self.starts[place] == at

    def spelled(self, finder: ahocorasick.Automaton | None) -> dict[str, list[tuple[int, int]]]:
        """Per text its occurrences from left to right, none of which overlap, as (start, end) in the laid words."""
        found: dict[str, list[tuple[int, int]]] = {}
        for last, text in finder.iter(self.text) if finder is not None else ():
            start = last + 1 - len(text)
            if self.begins(start):
                mine = found.setdefault(text, [])
                if not mine or start >= mine[-1][1]:
                    mine.append((start, last + 1))
        return found

    def words_of(self, start: int, end: int) -> tuple[int, int]:
        """The places of the first and the last word of an occurrence."""
        return bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1


def _listed(values) -> list:
    return [] if values is None else list(values)


def runs(words: Iterable[str | None], targets: Iterable[str | None]) -> list[tuple[int, int, int, int]]:
    """(target, occurrence, first word, last word) by places in both lists, in order of targets."""
    wanted = [_NORMALS[t] if t else "" for t in targets]
    texts = {t for t in wanted if t}
    if not texts:
        return []
    laid = LaidWords(words)
    found = laid.spelled(automaton(texts))
    return [(i, k, *laid.words_of(*at)) for i, t in enumerate(wanted) for k, at in enumerate(found.get(t, ()))]


#: Pages whose words are Python's at once.
PAGES = 128
_RUN = ("target", "occurrence", "first", "last")
_ARROW_RUNS = pa.list_(pa.struct([(f, pa.int32()) for f in _RUN]))


@arrow_udf(_struct(*_RUN))
def page_runs(words: pa.Array, targets: pa.Array) -> pa.Array:
    """``runs`` of each page, a few pages at a time, so that a batch costs little beyond its own bytes."""
    parts = []
    for at in range(0, len(words), PAGES):
        both = zip(words.slice(at, PAGES).to_pandas(), targets.slice(at, PAGES).to_pandas())
        parts.append(pa.array([[dict(zip(_RUN, r)) for r in runs(_listed(w), _listed(t))] for w, t in both], _ARROW_RUNS))
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW_RUNS)


@pandas_udf(T.ArrayType(_TEXT))
def on_page(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """Which needles a page has: literally, or spelled by its words.  Pages of one list of needles share the automata."""
    held: dict[tuple, tuple] = {}

    def one(text, listed):
        if text is None or listed is None:
            return []
        key = tuple(listed)
        if key not in held:
            held.clear()
            normal = {n: _NORMALS[n] for n in key}
            held[key] = normal, automaton(key), automaton({t for t in normal.values() if t})
        normal, literal, letters = held[key]
        seen = {n for _, n in literal.iter(text)}
        spelled = LaidWords(text.split()).spelled(letters) if letters is not None and len(seen) < len(key) else {}
        return [n for n in key if n in seen or normal[n] in spelled]

    return pd.Series([one(t, n) for t, n in zip(texts, needles)], dtype=object)


class Places:
    """Characters of a page that are taken, so that a span costs its own length however many there are."""

    def __init__(self, size: int):
        self.taken = bytearray(size)

    def take(self, start: int, end: int) -> bool:
        """Take a span unless some of it is taken."""
        if self.taken.find(1, start, end) >= 0:
            return False
        self.taken[start:end] = b"\x01" * (end - start)
        return True


def placed(text: str, targets: list[str | None], gaps: list) -> list[tuple[int, int, int, int]]:
    """(target, start, end, loose) of all occurrences that get their place, in order of precedence.

    First the literal ones of each target in turn, given by the lengths of text between them (``gaps``), then the runs
    of words that spell a target (loose = 1).
    """
    places, out = Places(len(text)), []
    for i, between in enumerate(gaps):
        at, size = 0, len(targets[i] or "")
        for gap in _listed(between):
            start = at + int(gap)
            at = start + size
            if places.take(start, at):
                out.append((i, start, at, 0))
    words, begins, ends, at = text.split(), [], [], 0
    for word in words:
        at = text.index(word, at)
        begins.append(at)
        at += len(word)
        ends.append(at)
    for i, _, first, last in runs(words, targets):
        if places.take(begins[first], ends[last]):
            out.append((i, begins[first], ends[last], 1))
    return out


@pandas_udf(_struct("target", "start", "end", "loose"))
def page_places(texts: pd.Series, targets: pd.Series, gaps: pd.Series) -> pd.Series:
    """``placed`` of each page; nothing on pages without text or targets."""
    return pd.Series([[] if x is None or t is None or not len(t) else placed(x, list(t), list(g)) for x, t, g in zip(texts, targets, gaps)], dtype=object)


def stretches(targets: list[str | None], gaps: list) -> list[tuple[int, int, int, int]]:
    """(target, start, end, 0) of what the literal occurrences given by ``gaps`` cover: those that overlap are one
    stretch, of the target that begins it (the longest of them)."""
    spans = []
    for i, between in enumerate(gaps):
        at, size = 0, len(targets[i] or "")
        for gap in _listed(between):
            start = at + int(gap)
            at = start + size
            spans.append((start, -at, i))
    out: list[list[int]] = []
    for start, end, i in sorted(spans):
        if out and start < out[-1][2]:
            out[-1][2] = max(out[-1][2], -end)
        else:
            out.append([i, start, -end, 0])
    return [(*s,) for s in out]


@pandas_udf(_struct("target", "start", "end", "loose"))
def page_stretches(targets: pd.Series, gaps: pd.Series) -> pd.Series:
    """``stretches`` of each page; nothing on pages without targets."""
    return pd.Series([[] if t is None or g is None else stretches(list(t), list(g)) for t, g in zip(targets, gaps)], dtype=object)

"""Rule matching (P3, B8-B10, E1): pages -> candidate entities.

``pages`` has doc_id, page and text (and whatever else the caller carries).  The
array form adds one ``candidates`` column and needs no shuffle: text never leaves
the task that read it.  The row form explodes that column.
"""

from __future__ import annotations

import json
import re
from typing import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from tachado import constants as K
from tachado.functions import patterns
from tachado.functions.arrays import bound, sums_before
from tachado.functions.reuse import once_per_session
from tachado.functions.spelling import automaton
from tachado.functions.text import as_col, is_blank
from tachado.operators.overlap import explode_entities
from tachado.schemas import CANDIDATE, CANDIDATES

_SPANS = T.ArrayType(T.StructType([
    T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType()), T.StructField("text", T.StringType())]))
_SPAN = ("start_offset", "end_offset", "text")
_ARROW_SPANS = pa.list_(pa.list_(pa.struct([("start_offset", pa.int32()), ("end_offset", pa.int32()), ("text", pa.string())])))
_STUDIED = T.StructType([T.StructField("usable", T.BooleanType()), T.StructField("jvm", T.StringType()),
                         T.StructField("required", T.ArrayType(T.StringType()))])


# ---------------------------------------------------------------- rules

def rule_list(rules: Iterable) -> list[dict]:
    """Rules as dicts, from dicts, rows or (type, pattern, enabled) triples."""
    out = []
    for r in rules:
        if isinstance(r, (tuple, list)) and not hasattr(r, "asDict"):
            r = dict(zip(("type", "pattern", "enabled"), r))
        elif hasattr(r, "asDict"):
            r = r.asDict()
        out.append({"type": r.get("type"), "pattern": r.get("pattern"), "enabled": r.get("enabled")})
    return out


def usable(rule: dict) -> bool:
    """Enabled (the default), with a type and a pattern that compiles and cannot match nothing."""
    return bool(rule["enabled"] is not False and rule["type"] and rule["pattern"]
                and patterns.compiles(rule["pattern"]) and not patterns.matches_nothing(rule["pattern"]))


def default_rules(enabled_only: bool = False) -> list[dict]:
    rules = rule_list(K.DEFAULT_RULES)
    return [r for r in rules if r["enabled"]] if enabled_only else rules


@pandas_udf(_STUDIED)
def _study(pattern: pd.Series) -> pd.DataFrame:
    rows = []
    for p in pattern:
        ok = bool(p) and patterns.compiles(p) and not patterns.matches_nothing(p)
        jvm = patterns.to_jvm(p) if ok else None
        rows.append((ok, jvm.pattern if jvm else None, list(jvm.required) if jvm else []))
    return pd.DataFrame(rows, columns=["usable", "jvm", "required"])


#: ASCII letters, digits and dots, at least one: compiles, matches no empty text, and reads the same in both dialects but for the dot.
_PLAIN = r"\A[A-Za-z0-9.]+\z"


def _plain_study(pattern: Column) -> Column:
    """What ``_study`` says of a pattern that is ``_PLAIN``, without leaving the row."""
    ahead = F.regexp_replace(F.regexp_extract(pattern, r"\A[A-Za-z0-9]", 0), "(.)", "(?=[$1])")
    return F.struct(F.concat(ahead, F.replace(pattern, F.lit("."), F.lit(r"[^\n]"))).alias("jvm"),
                    F.filter(F.split(pattern, r"\."), lambda x: x != "").alias("required"))


def usable_rules(rules: DataFrame) -> DataFrame:
    """Rule rows that can run, with their JVM form (null where only ``re`` can run them).

    Plain words are stated in the row; of other patterns each distinct one is studied once.
    """
    listed = rules.filter(F.coalesce("enabled", F.lit(True)) & (F.coalesce("type", F.lit("")) != "")
                          & (F.coalesce("pattern", F.lit("")) != ""))
    plain = F.col("pattern").rlike(_PLAIN)
    stated, other = listed.filter(plain).withColumn("s", _plain_study(F.col("pattern"))), listed.filter(~plain)
    # Called non-deterministic, lest the filter on its result moves below the distinct and every row is studied.
    studied = other.select("pattern").distinct().withColumn("s", _study.asNondeterministic()("pattern"))
    columns = [*rules.columns, F.col("s.jvm").alias("jvm"), F.col("s.required").alias("required")]
    return stated.select(*columns).unionByName(other.join(studied.filter("s.usable"), "pattern").select(*columns))


# ---------------------------------------------------------------- matching

def spans_of(text: Column, matches: Column, pattern: Column) -> Column:
    """Exact offsets of non-overlapping matches, from the pieces between them."""
    def span(z: Column, before: Column) -> Column:
        begin = before + z["gap"]
        return F.struct(begin.alias("start_offset"), (begin + F.length(z["m"])).alias("end_offset"), z["m"].alias("text"))

    # The tail after the last match has no match of its own and is left out.
    both = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("p"), matches.alias("m")), lambda z: z["m"].isNotNull())
    gaps = F.transform(both, lambda z: F.struct(F.length(z["p"]).alias("gap"), z["m"].alias("m")))
    return bound(gaps, lambda zs: F.zip_with(zs, sums_before(F.transform(zs, lambda z: z["gap"] + F.length(z["m"]))), span)).cast(_SPANS)


def _as_candidates(spans: Column, entity_type: Column, base_offset: int = 0) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(0).alias("ord"), entity_type.alias("type"),
        (s["start_offset"] + base_offset).alias("start_offset"),
        (s["end_offset"] + base_offset).alias("end_offset"), s["text"].alias("text"),
        F.lit(K.SOURCE_RULES).alias("source"), F.lit(K.RULE_CONFIDENCE).alias("confidence")).cast(CANDIDATE))


def numbered(candidates: Column) -> Column:
    """Candidates with ``ord`` set to their place in the array."""
    return F.transform(candidates, lambda c, i: c.withField("ord", i))


def _python_spans(rules: list[dict]):
    """Arrow fallback for rules the JVM cannot state exactly."""
    @pandas_udf(T.ArrayType(_SPANS))
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [re.compile(r["pattern"]) for r in rules]
        for batch in texts:
            yield batch.map(lambda t: None if t is None else [
                [(m.start(), m.end(), m.group()) for m in rx.finditer(t) if m.end() > m.start()]
                for rx in compiled])
    return find


def page_candidates(pages: DataFrame, rules: Iterable | None = None, base_offset: int = 0,
                    engine: str = "jvm") -> DataFrame:
    """``pages`` with the matches of every usable rule in a ``candidates`` array.

    ``rules`` is one list for all pages (the default catalogue if None); for rules
    per user see ``user_candidates``.  ``engine="arrow"`` sends every rule to ``re``.
    """
    active = [r for r in rule_list(K.DEFAULT_RULES if rules is None else rules) if usable(r)]
    stated = [(i, r, patterns.to_jvm(r["pattern"]) if engine == "jvm" else None) for i, r in enumerate(active)]
    native = [(i, r, j) for i, r, j in stated if j is not None]
    other = [(i, r) for i, r, j in stated if j is None]
    kept, text = list(pages.columns), F.col("text")
    none = F.array().cast(CANDIDATES)

    # Stage by stage, so that each pattern runs once and only hits are split.
    out = pages.withColumn("_digits", text.rlike(patterns.DIGIT + "{3}"))
    out = out.select(*kept, *[
        _matches(text, F.lit(j.pattern), j.required, F.col("_digits") if j.digit_run >= 3 else None).alias(f"_m{i}")
        for i, _, j in native])
    if other:
        out = out.withColumn("_py", F.when(is_blank(text), None).otherwise(_python_spans([r for _, r in other])(text)))
    # What each rule found, as one array, so the plan states the rest once however many rules there are.
    hits = []
    for i, r, j in stated:
        slot = [k for k, _ in other].index(i) if j is None else None
        hits.append(F.struct(
            F.lit(r["type"]).alias("type"), F.lit(j.pattern if j else None).cast("string").alias("jvm"),
            (F.col(f"_m{i}") if j else F.array().cast("array<string>")).alias("m"),
            (F.get("_py", F.lit(slot)) if j is None else F.lit(None).cast(_SPANS)).alias("spans")))
    if not hits:
        return out.select(*kept, none.alias("candidates"))
    found = F.filter(F.array(*hits), lambda h: (F.size(h["m"]) > 0) | (F.size(h["spans"]) > 0))
    out = out.select(*kept, found.alias("_found"))
    return out.select(*kept, F.when(F.size("_found") > 0, _candidates_of("text", "_found", base_offset))
                      .otherwise(none).alias("candidates"))


@once_per_session
def _candidates_of(text: str, found: str, base_offset: int = 0) -> Column:
    """Candidates of the rules that found something, in rule and match order."""
    return numbered(F.flatten(F.transform(found, lambda h: _as_candidates(
        F.coalesce(h["spans"], spans_of(F.col(text), h["m"], h["jvm"])), h["type"], base_offset))))


def _matches(text: Column, pattern: Column, required, digits: Column | None) -> Column:
    """All matches, after the cheap checks that rule out most pages."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checks = [text.contains(literal) for literal in dict.fromkeys(required)] + ([] if digits is None else [digits])
    if not checks:
        return matches
    guard = checks[0]
    for check in checks[1:]:
        guard = guard & check
    return F.when(guard, matches).otherwise(F.array().cast("array<string>"))


def detect_rules(pages: DataFrame, rules: Iterable | None = None, base_offset: int = 0,
                 engine: str = "jvm", carry: Iterable[str] = ()) -> DataFrame:
    """Every non-overlapping match of every usable rule, one row per match, with the page's ``carry`` columns."""
    return explode_entities(page_candidates(pages, rules, base_offset, engine), "candidates", ("doc_id", "page", *carry))


class _RuleSet:
    """A user's patterns, each compiled once, and an index from the literals they require to the patterns.

    One walk over a page by an automaton over all literals says which patterns can match there at all.
    """

    def __init__(self, patterns_: list[str], required: list[list[str]]):
        self.compiled = [re.compile(p) for p in patterns_]
        self.missing = [len(set(r)) for r in required]
        self.wanted_by: dict[str, list[int]] = {}
        for i, literals in enumerate(required):
            for literal in set(literals):
                self.wanted_by.setdefault(literal, []).append(i)
        self.literals = automaton(self.wanted_by)

    def admitted(self, text: str) -> list[bool]:
        missing = list(self.missing)
        for literal in {x for _, x in self.literals.iter(text)} if self.literals is not None else ():
            for i in self.wanted_by[literal]:
                missing[i] -= 1
        return [n == 0 for n in missing]

    def spans(self, text: str) -> list[list[tuple]]:
        return [[(m.start(), m.end(), m.group()) for m in rx.finditer(text) if m.end() > m.start()] if runs else []
                for rx, runs in zip(self.compiled, self.admitted(text))]


@arrow_udf(T.ArrayType(_SPANS))
def _user_spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The matches of each page's rules, rule by rule; none where the page or its rules are null.

    Texts become Python's one at a time, and a user's rules are one text, so that a batch costs little beyond its own bytes.
    """
    known: dict[str, _RuleSet] = {}

    def one(text, rules):
        if text is None or rules is None:
            return None
        if rules not in known:
            if len(known) >= RULE_SETS:
                known.clear()
            listed = json.loads(rules)
            known[rules] = _RuleSet([r["pattern"] for r in listed], [r.get("required") or [] for r in listed])
        return [[dict(zip(_SPAN, span)) for span in spans] for spans in known[rules].spans(text)]

    for texts, rules in batches:
        yield pa.array([one(t.as_py(), r.as_py()) for t, r in zip(texts, rules)], _ARROW_SPANS)


#: Users whose compiled rules a task keeps.
RULE_SETS = 512


def user_candidates(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``page_candidates`` with rules per user: ``rules`` has user_id, rule_idx, type, pattern, enabled.

    A user's rules travel as one array to that user's pages in one equi-join; no size is assumed, so the engine
    broadcasts the rules only when they are small and otherwise splits a hot user.  Only pages that hold all literals of
    some rule leave the JVM, and of their rules only those run that the page's literals admit, compiled once a task and
    user.  Patterns are run by ``re``, in whose dialect they are written.
    """
    ready = usable_rules(rules)
    per_user = ready.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(
        "rule_idx", "type", "pattern", "required"))).alias("_rules"))
    # What Python needs of a user's rules, as one text that is made once a user.
    per_user = per_user.withColumn("_stated", F.to_json(F.transform("_rules", lambda r: F.struct(r["pattern"].alias("pattern"), r["required"].alias("required")))))
    text = F.col("text")
    possible = F.exists("_rules", lambda r: F.forall(r["required"], lambda x: F.contains(text, x)))
    matched = pages.join(per_user, "user_id", "left").withColumn("_spans", _user_spans(
        F.when(possible, text), F.col("_stated")))
    found = numbered(F.flatten(F.transform(F.arrays_zip(F.col("_rules").alias("r"), F.col("_spans").alias("s")),
                                           lambda z: _as_candidates(z["s"], z["r"]["type"]))))
    return matched.select(*pages.columns, F.when(F.col("_spans").isNotNull(), found).otherwise(
        F.array().cast(CANDIDATES)).alias("candidates"))


# ---------------------------------------------------------------- page predicates

def non_blank(pages: DataFrame) -> DataFrame:
    """Pages with something other than white space on them."""
    return pages.filter(~is_blank("text"))


def engine_branches(pages: DataFrame, config: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages for the model, pages for the rules) by each user's method.

    Without ``config`` the pages carry their own ``method``; a missing method means
    both, an unknown one means neither.
    """
    with_method = pages if config is None else pages.join(config.select("user_id", "method"), "user_id", "left")
    method = F.coalesce("method", F.lit(K.DEFAULT_METHOD))
    return (with_method.filter(method.isin("ai", "both")), with_method.filter(method.isin("regex", "both")))


def offset_within(text, entity, start, tolerance: int = 5) -> Column:
    """Is the entity's text inside the window around the reported offset."""
    t, e, s = as_col(text), as_col(entity), as_col(start)
    begin = F.greatest(F.lit(0), s - tolerance)
    end = F.least(F.length(t), s + F.length(e) + tolerance)
    return F.contains(F.substr(t, begin + 1, F.greatest(F.lit(0), end - begin)), e)


def union_candidates(*branches: DataFrame) -> DataFrame:
    """All branches' candidates, duplicates kept."""
    first, *rest = branches
    for df in rest:
        first = first.unionByName(df)
    return first

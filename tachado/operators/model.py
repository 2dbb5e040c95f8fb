"""Detection by a language model (P4-P9, B13, B15, E2): pages -> prompts -> answers -> candidates."""

from __future__ import annotations

import json
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tachado import constants as K
from tachado.functions.arrays import bound, sums_before
from tachado.functions.display import clamp01, lookup
from tachado.functions.reuse import once_per_session
from tachado.functions.text import as_col, is_blank, quote, strip
from tachado.operators.overlap import candidate_order, explode_entities
from tachado.schemas import CANDIDATE, CANDIDATES

_PARSED = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("type", T.StringType()), T.StructField("hint", T.LongType())]))


def prompt_windows(pages: DataFrame, size: int = K.MODEL_TEXT_LIMIT, overlap: int = K.MODEL_WINDOW_OVERLAP) -> DataFrame:
    """Pages as overlapping windows of at most ``size`` characters, one model call each: no text goes unseen (P5).

    ``text`` becomes the window's; ``window``, ``window_start`` and ``page_chars`` say where it lies.
    """
    if not 0 <= overlap < size:
        raise ValueError("windows must be longer than their overlap")
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    cut = pages.withColumn("page_chars", n).select("*", F.posexplode(F.coalesce(starts, F.array(F.lit(0)))).alias("window", "window_start"))
    return cut.withColumn("text", F.substr("text", F.col("window_start") + 1, F.lit(size)))


def build_prompt(pages: DataFrame, template=None) -> DataFrame:
    """``prompt`` per page: every slot filled, text appended if there is no slot.

    ``template`` is a text or a column; a blank one gives no prompt but a
    ``prompt_error``, and the page yields nothing from the model.
    """
    t = F.lit(K.DEFAULT_PROMPT) if template is None else (template if isinstance(template, Column) else F.lit(template))
    slot = F.lit(K.PROMPT_SLOT)
    appended = F.concat(t, F.lit("\n\nTEXTO A ANALIZAR:\n---\n"), F.col("text"), F.lit("\n---"))
    filled = F.when(F.contains(t, slot), F.replace(t, slot, F.col("text"))).otherwise(appended)
    return (pages.withColumn("prompt", F.when(~is_blank(t), filled))
            .withColumn("prompt_error", F.when(is_blank(t), F.lit("no prompt configured"))))


def score_pages(prompts: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], temperature=K.DEFAULT_TEMPERATURE,
                batch: int | None = None) -> DataFrame:
    """``response`` and ``model_error`` per page from a scorer.

    ``scorer`` gets a frame with prompt, temperature (clamped to 0..1) and the
    page's own columns, and returns one answer per row.  A batch that fails is
    tried again row by row, so one bad page leaves the others alone; an empty
    answer is an error.
    """
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    ready = prompts.withColumn("temperature", clamp01(t))
    schema = T.StructType([*ready.schema.fields, T.StructField("response", T.StringType()), T.StructField("model_error", T.StringType())])

    def one_by_one(frame: pd.DataFrame):
        for i in range(len(frame)):
            try:
                yield scorer(frame.iloc[i:i + 1]).iloc[0], None
            except Exception as error:  # noqa: BLE001 - the model is somebody else's code
                yield None, f"{type(error).__name__}: {error}"

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            results = [(a, None) for a in scorer(frame)]
        except Exception:  # noqa: BLE001
            results = list(one_by_one(frame))
        texts = [a.strip() if isinstance(a, str) else "" for a, _ in results]
        errors = [e or (None if t else "empty answer") for t, (_, e) in zip(texts, results)]
        return frame.assign(response=[t or None for t in texts], model_error=errors)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch or max(1, len(frame))):
                part = frame.iloc[i:i + batch] if batch else frame
                if len(part):
                    asked = part[part["prompt"].notna()]
                    silent = part[part["prompt"].isna()]
                    if len(asked):
                        yield answer(asked)
                    if len(silent):
                        yield silent.assign(response=None, model_error=silent.get("prompt_error"))

    return ready.mapInPandas(run, schema)


def _elements(response):
    """The answer's array: the whole text, else from the first ``[`` to the last ``]``."""
    for part in (response, response[response.find("["):response.rfind("]") + 1]):
        try:
            value = json.loads(part)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, list):
            return value
    return None


def _parsed(response):
    if response is None:
        return None
    elements = _elements(response)
    if elements is None:
        return None
    rows = []
    for e in elements:
        if not isinstance(e, dict) or not isinstance(e.get("text"), str) or not isinstance(e.get("type"), str):
            continue
        hint = e.get("start_offset")
        whole = isinstance(hint, int) and not isinstance(hint, bool) and 0 <= hint < 2 ** 63
        # Surrogates that JSON escapes may carry cannot be part of any page.
        if any("\ud800" <= c <= "\udfff" for c in e["text"] + e["type"]):
            continue
        rows.append({"text": e["text"], "type": e["type"], "hint": hint if whole else 0})
    return rows


@pandas_udf(_PARSED)
def parse_response(responses: pd.Series) -> pd.Series:
    """Well-typed elements of each answer; null if there is no array in it.

    The JVM's lenient JSON functions accept trailing text and drop a whole array
    for one odd element, so answers go through ``json``: they are few and short.
    """
    return responses.map(_parsed)


def parse_responses(responses: DataFrame) -> DataFrame:
    """``parsed`` array and ``parse_error`` per answer."""
    return (responses.withColumn("parsed", parse_response("response"))
            .withColumn("parse_error", F.when(F.col("parsed").isNull(), F.lit("no JSON array in the answer"))))


def valid_entities(parsed, types: list[str] | None = None) -> Column:
    """Elements with a non-blank text and a known type: stripped and upper-cased."""
    clean = F.transform(as_col(parsed), lambda e: F.struct(
        strip(e["text"]).alias("text"), F.upper(e["type"]).alias("type"), e["hint"].alias("hint")))
    return F.filter(clean, lambda e: (e["text"] != "") & e["type"].isin(types or K.MODEL_TYPES))


def validate_model_entities(parsed: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Rows with ``parsed`` reduced to valid elements."""
    return parsed.withColumn("parsed", valid_entities("parsed", types))


def find_all(text, needle) -> Column:
    """Start of every occurrence, overlapping ones too.

    One split at a look-ahead walks the text once; the lengths of the pieces add
    up to the positions.
    """
    t, n = as_col(text), as_col(needle)
    sizes = F.transform(F.split(t, F.concat(F.lit("(?="), quote(n), F.lit(")")), -1), F.length)
    # Before the first piece is no cut; before each later one there is.
    cuts = bound(sums_before(sizes), lambda at: F.slice(at, F.lit(2), F.size(at)))
    none = F.array().cast("array<int>")
    at_start = F.when(F.startswith(t, n), F.array(F.lit(0))).otherwise(none)
    return F.when((n != "") & F.contains(t, n), F.concat(at_start, cuts)).otherwise(none)


def _nearest(positions: Column, hint: Column) -> Column:
    return F.array_min(F.transform(positions, lambda p: F.struct(F.abs(p - hint).alias("far"), p.alias("at"))))["at"]


@once_per_session
def located(text, entities) -> Column:
    """Valid elements as candidates at their true place in the text.

    Exact spelling first, then ignoring case; of several occurrences the one
    nearest the hint, the earlier on a tie; none means the model made it up.
    """
    t = as_col(text)
    low = F.lower(t)

    def place(e):
        exact = find_all(t, e["text"])
        loose = find_all(low, F.lower(e["text"]))
        return F.coalesce(_nearest(exact, e["hint"]), _nearest(loose, e["hint"]))

    found = F.transform(as_col(entities), lambda e: F.struct(e.alias("e"), place(e).alias("at")))
    spelled = F.transform(F.filter(found, lambda f: f["at"].isNotNull()), lambda f: F.struct(
        F.lit(0).alias("ord"), f["e"]["type"].alias("type"), f["at"].alias("start_offset"),
        (f["at"] + F.length(f["e"]["text"])).alias("end_offset"),
        F.substr(t, f["at"] + 1, F.length(f["e"]["text"])).alias("text"),
        F.lit(K.SOURCE_MODEL).alias("source"), F.lit(K.MODEL_CONFIDENCE).alias("confidence"),
        f["e"]["text"].alias("said")))
    # Lower-casing can change lengths; a shifted hit does not read the same and goes.
    same = F.filter(spelled, lambda c: F.lower(c["text"]) == F.lower(c["said"]))
    return F.transform(same, lambda c, i: F.struct(
        i.alias("ord"), c["type"], c["start_offset"], c["end_offset"], c["text"], c["source"], c["confidence"]
    ).cast(CANDIDATE))


def model_candidates(pages: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Pages with a ``response`` -> pages with a ``candidates`` array of located entities."""
    parsed = pages.withColumn("_valid", F.when(F.col("response").isNotNull(), parse_response("response")))
    parsed = parsed.withColumn("_valid", valid_entities("_valid", types))
    return parsed.withColumn("candidates", F.when(F.size("_valid") > 0, located("text", "_valid"))
                             .otherwise(F.array().cast(CANDIDATES))).drop("_valid")


def locate_entities(pages: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Located model entities, one row each."""
    return explode_entities(model_candidates(pages, types), "candidates")


def locate_in_windows(windows: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Entities of answered windows (``prompt_windows``), one row each, at their place in the page.

    What touches an inner edge may be cut off there and is left to the neighbour, which holds it whole; what two
    windows found counts once.
    """
    found = model_candidates(windows, types)
    whole = F.filter("candidates", lambda c: ((c["start_offset"] > 0) | (F.col("window_start") == 0)) & (
        (c["end_offset"] < F.length("text")) | (F.col("window_start") + F.length("text") >= F.col("page_chars"))))
    moved = F.transform(whole, lambda c: c.withField("start_offset", c["start_offset"] + F.col("window_start")).withField(
        "end_offset", c["end_offset"] + F.col("window_start")).cast(CANDIDATE))
    rows = explode_entities(found.withColumn("candidates", moved), "candidates", ("doc_id", "page", "window"))
    names = [c for c in rows.columns if c != "window"]
    once = rows.groupBy(*[c for c in names if c != "ord"]).agg(F.min(F.struct("window", "ord")).alias("_seen"))
    return candidate_order(once.withColumn("ord", F.lit(0)), ["_seen"]).select(*names)


def map_types(entities: DataFrame, mapping: dict | None = None) -> DataFrame:
    """External type names to own ones; unmapped entities go."""
    own = lookup("type", mapping or K.EXTERNAL_TYPES, F.lit(None).cast("string"))
    return entities.withColumn("type", own).filter("type is not null")


def capitalized_names_scorer(frame: pd.DataFrame) -> pd.Series:
    """A deterministic stand-in for a model: names two capitalised words in a row."""
    import re
    name = re.compile(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")
    return frame["text"].map(lambda t: json.dumps(
        [{"text": m.group(), "type": "NOMBRE", "start_offset": m.start()} for m in name.finditer(t)]))

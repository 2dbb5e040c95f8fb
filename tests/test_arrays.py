"""Running sums in arrays, and what is built on them, on rows with very many elements."""

import re
import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tachado.functions import text as T
from tachado.functions.arrays import bound, sums_before
from tachado.operators import detect, model, residual


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 256, 1000])
def test_sums_before(spark, n):
    sizes = [(i * 7) % 11 - 3 for i in range(n)]
    got = spark.createDataFrame([(sizes,), (None,)], "a array<int>").select(sums_before(F.col("a")).alias("s")).collect()
    assert [r.s for r in got] == [[0, *accumulate(sizes)][:n], None]


def test_bound_uses_one_value(spark):
    r = spark.range(1).select(bound(F.rand(), lambda x: F.array(x, x)).alias("a")).first()
    assert r.a[0] == r.a[1]


def test_many_matches_on_one_page(spark):
    """A page with 60 000 matches of one rule: offsets as ``re`` has them, found by literal too, and labels by place."""
    text = "ñ ana@x.org, " * 60_000
    pages = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "")], "doc_id int, page int, text string")
    rule = {"type": "EMAIL", "pattern": r"[a-z]+@[a-z]+\.[a-z]{2,}"}
    begun = time.monotonic()
    found = detect.page_candidates(pages, [rule]).select("doc_id", F.transform("candidates", lambda c: F.struct(
        c["start_offset"].alias("s"), c["end_offset"].alias("e"))).alias("at")).collect()
    want = [m.span() for m in re.finditer(rule["pattern"], text)]
    assert {r.doc_id: [tuple(x) for x in r.at] for r in found} == {1: want, 2: [], 3: []}
    places = pages.select(model.find_all(F.col("text"), F.lit("ana@")).alias("p")).first().p
    assert places == [s for s, _ in want]
    assert time.monotonic() - begun < 60


def test_label_places(spark):
    """Where labels lie once all spans before them have changed their length."""
    ents = [(10 * i, 10 * i + 1 + i % 9) for i in range(400)]
    rows = spark.createDataFrame([([("DNI", "regex", s, e) for s, e in ents],)], "x array<struct<type:string,source:string,start_offset:int,end_offset:int>>")
    got = [tuple(p) for p in rows.select(residual.label_spans("x", {"DNI": "<dni>"}).alias("p")).first().p]
    sizes = {e - s for s, e in got}
    assert len(sizes) == 1
    n, moved, want = sizes.pop(), 0, []
    for s, e in ents:
        want.append((s + moved, s + moved + n))
        moved += n - (e - s)
    assert got == want


def test_normal_texts_by_table_and_by_rule(spark):
    """Every character alone, and beside others, comes out as the rule says, whichever way it takes."""
    every = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D500), 0x1F600]]
    texts = [*every, *("Á" + c + "z" for c in every[::7]), "", "ﬁn ½ Ｗ º 한글", "Ünïcödé - ΑΒΓ", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize_text("t").alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: T.normalized(t) for i, t in enumerate(texts)}

import random
import re

import pytest
from pyspark.sql import functions as F

from tachado import constants as K
from tachado.functions import patterns
from tachado.operators import detect, overlap

PAGES = [
    ("d1", 1, "DNI: 31.222.333", [("DNI", 5, 15)]),
    ("d1", 2, "Ana: 31.222.333, Luz: 4.555.666", [("DNI", 5, 15), ("DNI", 22, 31)]),
    ("d2", 1, "DNI: 31.222.333, CUIT: 20-11223344-5", [("DNI", 5, 15), ("CUIT_CUIL", 23, 36)]),
    ("d3", 1, "Expediente: EX-2025-12345678-APN-ABC#DEF", [("EXPEDIENTE_GDE", 12, 40)]),
    ("d3", 2, "EX-2025-1-APN-X#Y", []),
    ("d4", 1, "   ", []),
    ("d5", 1, "Texto sin datos", []),
    ("d6", 1, "Tel. é12.345.678", []),
    ("d7", 1, "😀 31.222.333", [("DNI", 2, 12)]),
    ("d8", 1, "Pasaporte AAB123456", [("PASAPORTE", 10, 19)]),
    ("d8", 2, "CBU 1234567890123456789012", [("CUENTA_BANCARIA", 4, 26)]),
    ("d8", 3, "IBAN ES9121000418450200051332", [("CUENTA_BANCARIA", 5, 29)]),
    ("d8", 5, "t ghp_" + "a1B2" * 9, [("TOKEN_GITHUB", 2, 42)]),
    ("d8", 6, "Ex EX-2021-58954571- -APN-DGD#MT", [("EXPEDIENTE_GDE", 3, 32)]),
    ("d8", 7, "mail: a.b+c@d.org, tel +54 11 4567 8901", [("EMAIL", 6, 17), ("TELEFONO", 23, 39)]),
    ("d8", 8, "Tarjeta 4532-1234-5678-9012 vence", [("TARJETA_CREDITO", 8, 28)]),
    ("d8", 9, "ip 94.102.185.7", [("DNI", 3, 13)]),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([p[:3] for p in PAGES], "doc_id string, page int, text string")


@pytest.mark.parametrize("engine", ["jvm", "arrow"])
def test_default_rules_on_known_pages(pages, engine):
    got = {}
    for r in detect.detect_rules(pages, engine=engine).collect():
        got.setdefault((r.doc_id, r.page), []).append((r.type, r.start_offset, r.end_offset))
        assert r.source == "regex" and r.confidence == 0.95
    for doc, page, text, expected in PAGES:
        assert sorted(got.get((doc, page), [])) == sorted(expected), text


def test_dates_need_their_rule(spark):
    df = spark.createDataFrame([("d", 1, "Nacido 01/02/1990 o 1990-02-01")], "doc_id string, page int, text string")
    rule = [dict(r, enabled=True) for r in detect.default_rules() if r["type"] == "FECHA"]
    assert [(r.start_offset, r.end_offset) for r in detect.detect_rules(df, rule).collect()] == [(7, 17), (20, 30)]


def test_unusable_rules_are_skipped(spark):
    df = spark.createDataFrame([("d", 1, "uno 31.222.333")], "doc_id string, page int, text string")
    dni = K.DEFAULT_RULES[0][1]
    rules = [{"type": "DNI", "pattern": dni, "enabled": False}, {"type": "X", "pattern": "(["}, {"type": "", "pattern": "u"},
             {"type": "X", "pattern": ""}, {"type": "V", "pattern": "q*"}, {"type": "A", "pattern": dni}, {"type": "B", "pattern": dni}]
    rows = detect.detect_rules(df, rules).orderBy("ord").collect()
    assert [(r.type, r.ord) for r in rows] == [("A", 0), ("B", 1)]


def test_base_offset(spark):
    df = spark.createDataFrame([("d", 1, "31.222.333")], "doc_id string, page int, text string")
    r = detect.detect_rules(df, base_offset=100).first()
    assert (r.start_offset, r.end_offset) == (100, 110)


TEXTS = [
    "áb 12 x_1 é9 ½7 Ñandú\n fin z\x1cq", "aaa\nbbb\r\n", "Zoë-Ana 1.2.3", "", "١٢٣.456.789", "🙂x🙂🙂y",
    "foo.bar+baz@ex-ample.co.uk, (011) 4444-5555", "EXP N° 123/2024 EXPTE. 9-99", "x" * 50,
]
RE_PATTERNS = [
    r"\bé?\w+\b", r"\d+", r"\s+", r"[^\W\d]+", r".+", r"^\w", r"\w$", r"(?<=a)b", r"(?<!\d)\d{1,2}(?!\d)", r"(?:a|b)+", r"[\s\-]", r"\Bx",
    r"x+?", r"[^\sa]", r"\S+@\S+", r"🙂+", r"\D\d", r"[é-ñ]", r"(a)(b)?", r"\.", r"[]x-]", r"a{2}", r"\w+\Z",
]


@pytest.mark.parametrize("pattern", RE_PATTERNS + [p for _, p, _ in K.DEFAULT_RULES])
def test_jvm_form_finds_what_re_finds(spark, pattern):
    assert patterns.to_jvm(pattern) is not None
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(TEXTS)], "doc_id int, page int, text string").coalesce(1)
    got = {}
    for r in detect.detect_rules(df, [{"type": "T", "pattern": pattern}]).collect():
        got.setdefault(r.doc_id, []).append((r.start_offset, r.end_offset, r.text))
    for i, t in enumerate(TEXTS):
        expected = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t) if m.end() > m.start()]
        assert sorted(got.get(i, [])) == expected, (pattern, t)


@pytest.mark.parametrize("pattern", [r"(\w)\1", r"(?i)abc", r"(?P<n>a)(?(n)b|c)", r"(?P<a>x)(?P=a)"])
def test_patterns_without_a_jvm_form_fall_back(spark, pattern):
    assert patterns.to_jvm(pattern) is None
    text = "aabb ABC xx ab"
    df = spark.createDataFrame([(1, 1, text)], "doc_id int, page int, text string")
    got = [(r.start_offset, r.end_offset) for r in detect.detect_rules(df, [{"type": "T", "pattern": pattern}]).collect()]
    assert got == [m.span() for m in re.finditer(pattern, text)]


def test_rules_per_user(spark):
    pages = spark.createDataFrame([(1, 1, "aa 12", "u"), (2, 1, "aa 12", "v"), (3, 1, "aa 12", "w")],
                                  "doc_id int, page int, text string, user_id string")
    rules = spark.createDataFrame([("u", 0, "N", r"\d+", True), ("u", 1, "R", r"(a)\1", None), ("u", 2, "N2", r"1", True),
                                   ("v", 0, "B", "([", True), ("v", 1, "A", "a", True), ("v", 2, "Z", "2", False)],
                                  "user_id string, rule_idx int, type string, pattern string, enabled boolean")
    found = overlap.explode_entities(detect.user_candidates(pages, rules), "candidates")
    assert sorted((r.doc_id, r.ord, r.type, r.start_offset) for r in found.collect()) == [
        (1, 0, "N", 3), (1, 1, "R", 0), (1, 2, "N2", 3), (2, 0, "A", 0), (2, 1, "A", 1)]


def test_engine_branches(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "doc_id int, user_id string")
    config = spark.createDataFrame([("a", "ai"), ("b", "regex"), ("c", "both"), ("d", "magic")], "user_id string, method string")
    ai, rules = detect.engine_branches(pages, config)
    assert sorted(r.doc_id for r in ai.collect()) == [1, 3, 5]
    assert sorted(r.doc_id for r in rules.collect()) == [2, 3, 5]


def test_blank_pages_and_tolerance(spark):
    df = spark.createDataFrame([(1, " \t\n  "), (2, " x "), (3, "")], "doc_id int, text string")
    assert [r.doc_id for r in detect.non_blank(df).collect()] == [2]
    t = spark.range(1).select(
        detect.offset_within(F.lit("0123456789Ana0123456789"), F.lit("Ana"), F.lit(5)).alias("a"),
        detect.offset_within(F.lit("0123456789Ana0123456789"), F.lit("Ana"), F.lit(4)).alias("b"),
        detect.offset_within(F.lit("0123456789Ana0123456789"), F.lit("Ana"), F.lit(15)).alias("c"),
        detect.offset_within(F.lit("0123456789Ana0123456789"), F.lit("Ana"), F.lit(16)).alias("d")).first()
    assert tuple(t) == (True, False, True, False)


def test_rules_of_users_by_their_literals(spark):
    """Fifty rules a user over short pages: what comes out is what each rule finds alone."""
    random.seed(8)
    rules = [(u, i, f"T{i}", p, None) for u in "ab" for i, p in enumerate(
        [rf"\bk{i}-{u}\d+" for i in range(40)] + [r"(\d)\1{2,}", r"(?i)hola", r"a+b?", r"[xyz]{2}", r"(uno|dos) y tres", "([", "a*", r"é\w+", r"\Bq\B", r"fin$"])]
    words = ["k3-a12", "k39-b7", "HOLA", "1112", "xyz", "dos y tres", "écran", "aqui", "fin", "k3-b1", "aab"]
    pages = [(i, 1, random.choice(["a", "b", "c", None]), " ".join(random.choices(words, k=6)) if i % 9 else random.choice([None, ""])) for i in range(300)]
    found = detect.user_candidates(spark.createDataFrame(pages, "doc_id int, page int, user_id string, text string"),
                                   spark.createDataFrame(rules, "user_id string, rule_idx int, type string, pattern string, enabled boolean"))
    got = {r.doc_id: [(c.ord, c.type, c.start_offset, c.end_offset, c.text) for c in r.candidates] for r in found.collect()}
    for doc, _, user, text in pages:
        want = []
        for u, _, kind, pattern, _ in rules:
            if u == user and text and pattern not in ("([", "a*"):
                want += [(kind, m.start(), m.end(), m.group()) for m in re.finditer(pattern, text)]
        assert got[doc] == [(i, *w) for i, w in enumerate(want)]

import random

import pytest
from pyspark.sql import functions as F

from tachado.operators import mask, overlap
from tachado.plans import corpus

SCHEMA = "doc_id int, page int, ord int, type string, start_offset int, end_offset int, text string, source string, confidence double"


def sequential(cands, clash, beats):
    """The rule as it is told: every pair in order, the loser goes, stop when it is me."""
    gone = set()
    for i in range(len(cands)):
        if i in gone:
            continue
        for j in range(i + 1, len(cands)):
            if j in gone or not clash(cands[i], cands[j]):
                continue
            if beats(cands[j], cands[i]):
                gone.add(i)
                break
            gone.add(j)
    return [i for i in range(len(cands)) if i not in gone]


def overlaps(a, b):
    return max(a[4], b[4]) < min(a[5], b[5])


def rank(c):
    return (c[5] - c[4], c[8], {"regex": 3, "bedrock": 2}.get(c[7], 0))


def duplicate(a, b):
    shorter = min(a[5] - a[4], b[5] - b[4])
    shared = max(0, min(a[5], b[5]) - max(a[4], b[4]))
    return a[3] == b[3] and shorter != 0 and shared / shorter > 0.8


def random_pages(n, seed):
    rnd = random.Random(seed)
    rows = []
    for d in range(n):
        for o in range(rnd.randrange(0, 14)):
            s = rnd.randrange(0, 30)
            rows.append((d, 1, o, rnd.choice("AB"), s, s + rnd.choice([0, 1, 2, 3, 5, 8, 13]), "x", rnd.choice(["regex", "bedrock", "otro"]), rnd.choice([0.85, 0.95])))
    return rows


@pytest.mark.parametrize("name", ["resolve", "dedup"])
def test_fold_is_the_sequential_rule(spark, name):
    rows = random_pages(600, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    if name == "resolve":
        got = overlap.resolve_overlaps(df)
        clash, beats = overlaps, lambda b, a: rank(b) > rank(a)
    else:
        got = overlap.dedup_same_type(df)
        clash, beats = duplicate, lambda b, a: rank(b)[:2] > rank(a)[:2]
    kept = {}
    for r in got.collect():
        kept.setdefault(r.doc_id, []).append((r.start_offset, r.ord))
    for d in range(600):
        page = [r for r in rows if r[0] == d]
        expected = sorted((page[i][4], i) for i in sequential(page, clash, beats))
        assert kept.get(d, []) == expected, page


CASES = [
    ([(0, 5), (5, 10)], [0, 1]), ([(0, 5), (4, 10)], [1]), ([(0, 5), (4, 10), (9, 16)], [2]),
    ([(0, 6), (5, 12), (0, 4)], [1, 2]), ([(0, 6), (0, 4), (5, 12)], [2]), ([(0, 8), (0, 8)], [0]),
]


@pytest.mark.parametrize("spans,expected", CASES)
def test_known_overlaps(spark, spans, expected):
    rows = [(1, 1, i, "T", s, e, "x", "regex", 0.95) for i, (s, e) in enumerate(spans)]
    got = overlap.resolve_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.ord for r in got) == expected


def test_winner_of_equal_spans_and_pages_apart(spark):
    rows = [(1, 1, 0, "N", 0, 8, "x", "bedrock", 0.90), (1, 1, 1, "D", 0, 8, "x", "regex", 0.95),
            (1, 2, 0, "N", 0, 8, "x", "bedrock", 0.95), (1, 2, 1, "D", 0, 8, "x", "regex", 0.95)]
    got = overlap.resolve_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page, r.type) for r in got) == [(1, "D"), (2, "D")]


def test_ratio_and_pairs(spark):
    r = spark.range(1).select(overlap.overlap_ratio(F.lit(0), F.lit(10), F.lit(6), F.lit(16)), overlap.overlap_ratio(F.lit(0), F.lit(10), F.lit(2), F.lit(8)),
                              overlap.overlap_ratio(F.lit(0), F.lit(0), F.lit(0), F.lit(8))).first()
    assert tuple(r) == (0.4, 1.0, 0.0)
    rows = random_pages(80, 3)
    got = {(r.doc_id, r.ord_a, r.ord_b) for r in overlap.overlap_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and overlaps(a, b)}
    assert got == expected


def masked_by_hand(text, ents):
    def name(e):
        s = {"regex": "-R", "bedrock": "-IA", "comprehend": "-C"}.get(e[7], "")
        return f"[{e[3]}{s}]"
    for e in sorted(ents, key=lambda e: e[4], reverse=True):
        s, n = e[4], e[5]
        if s < 0 or n <= s or n > len(text):
            if e[6] and e[6] in text:
                text = text.replace(e[6], name(e), 1)
            continue
        text = text[:s] + name(e) + text[n:]
    return text


def test_masking_matches_the_right_to_left_rule(spark):
    rnd = random.Random(5)
    alphabet = "añb 😀c\n"
    pages, ents = [], []
    for d in range(300):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60)))
        pages.append((d, 1, text))
        for o in range(rnd.randrange(0, 6)):
            s = rnd.randrange(-1, 50)
            e = s + rnd.randrange(0, 9)
            ents.append((d, 1, o, rnd.choice(["DNI", "X"]), s, e, rnd.choice(["", "a", "ñb", "zz", text[max(0, s):max(0, e)]]), rnd.choice(["regex", "bedrock", "comprehend", "otro"]), 0.9))
    out = mask.mask_text(spark.createDataFrame(pages, "doc_id int, page int, text string"), spark.createDataFrame(ents, SCHEMA))
    for r in out.collect():
        mine = [e for e in ents if e[0] == r.doc_id]
        assert r.masked_text == masked_by_hand(pages[r.doc_id][2], mine), (pages[r.doc_id], mine)


def test_many_entities_on_one_page(spark):
    text = " ".join(f"u{i}@mail.org é" for i in range(500))
    df = spark.createDataFrame([(1, 1, text)], "doc_id int, page int, text string")
    r = corpus.mask_pages(df).first()
    assert len(r.entities) == 500
    assert r.masked_text == " ".join("[EMAIL-R] é" for _ in range(500))
    again = corpus.mask_pages(spark.createDataFrame([(1, 1, r.masked_text)], "doc_id int, page int, text string")).first()
    assert again.masked_text == r.masked_text


def test_labels_names_colours(spark):
    r = spark.range(1).select(
        mask.label(F.lit("DNI"), F.lit("bedrock")), mask.label(F.lit("DNI"), F.lit("x")), mask.label(F.lit(""), F.lit(None).cast("string")),
        mask.output_name(F.lit("a/b.c.pdf"), "pdf"), mask.output_name(F.lit("noext"), "markdown"), mask.output_name(F.lit(".env"), "pdf"),
        mask.output_name(F.lit("x."), "pdf"), mask.highlight(F.lit("DNI"))["g"], mask.highlight(F.lit("OTRO"))["r"]).first()
    assert tuple(r) == ("[DNI-IA]", "[DNI]", "[PII]", "b.c_ofuscado.pdf", "noext_informe.md", ".env_ofuscado.pdf", "x._ofuscado.pdf", 0.8, 0.9)
    with pytest.raises(ValueError):
        mask.output_name(F.lit("a"), "docx")


def test_report_sections_in_page_order(spark):
    df = spark.createDataFrame([("d", 3, "tres", "a.pdf"), ("d", 1, "uno", "a.pdf"), ("d", 2, "", "a.pdf")], "doc_id string, page int, masked_text string, file_name string")
    rows = mask.page_report(df).orderBy("section").collect()
    assert "\n".join(r.body for r in rows) == (
        "# Informe de Ofuscación: a.pdf\n\n**Archivo original:** a.pdf\n\n---\n\n## Página 1\n\nuno\n\n## Página 2\n\n\n\n## Página 3\n\ntres\n")


def test_ignore_and_switches(spark):
    ents = spark.createDataFrame([("u", 1, 1, 0, "DNI", 0, 1, " Straße ", "regex", .9), ("u", 1, 1, 1, "RARO", 0, 1, "b", "regex", .9), ("v", 1, 1, 2, "DNI", 0, 1, "STRASSE", "regex", .9)], "user_id string, " + SCHEMA)
    ignored = spark.createDataFrame([("u", "STRASSE\t"), ("u", "  "), ("u", "z")], "user_id string, value string")
    assert sorted(r.ord for r in mask.drop_ignored(ents, ignored).collect()) == [1, 2]
    toggles = spark.createDataFrame([("u", "DNI", False), ("u", "RARO", False)], "user_id string, type string, active boolean")
    assert sorted(r.ord for r in mask.keep_active_types(ents, toggles).collect()) == [1, 2]

"""Strays masked as their SQL says: literally, and overlapping occurrences as one place."""

import random

import duckdb
from pyspark.sql import functions as F

from tachado.functions import spelling
from tachado.operators import locate
from tachado.plans.oracle import ORACLE
from tachado.plans.queries import QUERIES


def test_strays_against_sql(spark, tmp_path):
    """Other spellings and cases of what was found, and matches that overlap in chains, on two pages."""
    def text(head, *rest):
        return "\n".join([head, *["x"] * 19, *rest])

    texts = [text("a: 555-123-4567", "555.123.4567 b", "555 123 4567"), text("to Ana@paz.com ana@paz.com", "ANA@PAZ.COM, anap az@pazcom"),
             text("20-12345678-9 1234-5678", "12345678-9"), text("ab 123.4567.1234.5678.123.4567", "4567.1234 4567 1234", "123 4567"), None, ""]
    random.seed(3)
    pieces = ["123", "4567", "4567", "1234567", " ", "-", ".", " ", "a@b.co", "A@b.co", "\n", "x"]
    texts += ["".join(random.choices(pieces, k=random.randint(20, 160))) for _ in range(300)]
    spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["mask_strays"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLE["mask_strays"]).fetchall())


def test_stretches_against_marked_characters():
    random.seed(7)
    for _ in range(500):
        text = "".join(random.choices("ab", k=20))
        targets = [None, *["".join(random.choices("ab", k=random.randint(1, 4))) for _ in range(random.randint(0, 4))]]
        spans = [(i, [len(p) for p in text.split(t)[:-1]]) if t else (i, None) for i, t in enumerate(targets)]
        got = spelling.stretches(targets, [g for _, g in spans])
        places = []
        for i, gaps in spans:
            at = 0
            for gap in gaps or ():
                places.append((at + gap, at + gap + len(targets[i])))
                at += gap + len(targets[i])
        covered = {c for s, e in places for c in range(s, e)}
        assert {c for _, s, e, _ in got for c in range(s, e)} == covered
        starts = {s for s, _ in places if not any(a < s < b for a, b in places)}
        assert [s for _, s, _, _ in got] == sorted(starts)


def test_as_written_masks_whole_stretches(spark):
    ents = spark.createDataFrame([(1, 1, 0, "B", 0, 1, "3-4 5", "regex", .9), (1, 1, 1, "A", 0, 1, "1 2 3-", "regex", .9), (1, 1, 2, "C", 0, 1, "ana", "regex", .9)],
                                 "doc_id int, page int, ord int, type string, start_offset int, end_offset int, text string, source string, confidence double")
    pages = spark.createDataFrame([(1, 1, "1 2 3-4 5 Ana a-na ana"), (1, 2, None)], "doc_id int, page int, text string")
    got = {r.page: (r.occurrences_masked, r.masked_text) for r in locate.mask_occurrences(pages, ents, as_written=True).collect()}
    assert got == {1: (2, "[A-R] Ana a-na [C-R]"), 2: (0, None)}
    assert locate.mask_occurrences(pages, ents.filter(F.lit(False)), as_written=True).filter("occurrences_masked > 0").count() == 0

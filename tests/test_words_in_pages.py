"""Words are cut where a page has met its targets, and only those found become rows."""

from pyspark.sql import functions as F

from tachado.functions import spelling
from tachado.operators import geometry, locate
from tachado.plans import roles
from tachado.plans.queries import QUERIES

KEYS = ["doc_id", "page", "ord", "occurrence"]


def test_boxes_move_no_words(spark):
    """Pages, their targets, boxes of a page, and the sums: nothing else is shuffled, no word is a row before it is found."""
    plan = QUERIES["dedup_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "Window" not in plan


def test_words_in_rows_and_in_pages_agree(spark):
    pages = spark.createDataFrame([(1, 1, "José - Luis Paz jose luis  a b c d e f"), (1, 2, ""), (2, 1, None), (3, 1, "x")], "doc_id int, page int, text string")
    ents = spark.createDataFrame([(1, 1, 0, "jose luis"), (1, 1, 1, "Luis Paz jose luis a b c"), (1, 1, 2, None), (1, 1, 3, "--"), (1, 2, 0, "x"), (2, 1, 0, "x"), (4, 1, 0, "x"), (3, 1, 7, "X")],
                                 "doc_id int, page int, ord int, text string")
    fields = ["x0", "y0", "x1", "y1", "block", "line"]
    by_row = locate.locate_tolerant(ents, roles.words(pages), fields)
    by_page = locate.locate_in_pages(ents, pages, roles.page_words(), roles.laid_word)
    assert by_row.columns == by_page.columns and sorted(by_row.collect()) == sorted(by_page.collect()) and by_page.count() == 4
    boxes = [tuple(r) for r in geometry.boxes_per_line(by_page, KEYS).orderBy(*KEYS, "box").collect()]
    assert boxes[2:4] == [(1, 1, 1, 0, 0, 120.0, 0.0, 426.0, 10.0), (1, 1, 1, 0, 1, 0.0, 12.0, 6.0, 22.0)]
    plain = locate.locate_in_pages(ents, pages, roles.page_words()).filter("doc_id = 3").select("ord", "run", F.size("run").alias("n")).first()
    assert (plain.ord, plain.n, plain.run[0].word_ord, plain.run[0].text) == (7, 1, 0, "x")


def test_boxes_of_broken_runs(spark):
    """A null line or block begins a box, words come in order, missing corners count for nothing."""
    word = "struct<word_ord:int,x0:double,y0:double,x1:double,y1:double,block:int,line:int>"
    run = [(2, 9.0, 0.0, 12.0, 5.0, 0, 1), (0, 1.0, 0.0, 4.0, 5.0, 0, 0), (1, 5.0, -1.0, 8.0, None, 0, 0), (3, 0.0, 0.0, 1.0, 1.0, 0, None), (4, 0.0, 0.0, 1.0, 1.0, 0, None)]
    got = geometry.boxes_per_line(spark.createDataFrame([(1, run), (2, [])], f"k int, run array<{word}>"), ["k"]).orderBy("box").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1.0, -1.0, 8.0, 5.0), (1, 1, 9.0, 0.0, 12.0, 5.0), (1, 2, 0.0, 0.0, 1.0, 1.0), (1, 3, 0.0, 0.0, 1.0, 1.0)]


def test_words_that_hold_the_separator():
    assert spelling.runs(["a\0b", "c", None, "", "\0"], ["c", "a\0b c", "\0"]) == [(0, 0, 1, 1), (1, 0, 0, 1), (2, 0, 4, 4)]
    assert spelling.runs([], ["a"]) == []

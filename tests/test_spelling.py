"""Many texts found in one walk over a page, against one pattern per text."""

import random
import re
import time

from pyspark.sql import functions as F

from tachado.functions import spelling
from tachado.functions.text import normalized
from tachado.operators import locate


def brute_runs(words, targets):
    normal = [normalized(w) for w in words]
    kept = [(i, n) for i, n in enumerate(normal) if n]
    joined = "".join(f" {n}" for _, n in kept)
    out = []
    for i, target in enumerate(targets):
        t = normalized(target) if target else ""
        for k, m in enumerate(re.finditer(" " + " ?".join(map(re.escape, t)), joined) if t else ()):
            out.append((i, k, kept[joined[:m.start()].count(" ")][0], kept[joined[:m.end()].count(" ") - 1][0]))
    return out


def test_runs_against_patterns():
    random.seed(4)
    letters = ["a", "b", "é", "-", "ab", "aab", "b.a", "ﬁ", "ÁB", "İ"]
    for _ in range(3000):
        words = ["".join(random.choices(letters, k=random.randint(1, 3))) for _ in range(random.randint(0, 12))]
        targets = [random.choice([None, "", " "]) if random.random() < .1 else " - ".join(random.choices(letters, k=random.randint(1, 3))) for _ in range(random.randint(0, 6))]
        assert spelling.runs(words, targets) == brute_runs(words, targets)


def brute_placed(every):
    kept = []
    for c in every:
        if all(max(c[1], k[1]) >= min(c[2], k[2]) for k in kept):
            kept.append(c)
    return kept


def test_places_against_all_pairs():
    random.seed(5)
    for _ in range(2000):
        every = [(i, s := random.randint(0, 60), s + random.randint(1, 9)) for i in range(random.randint(0, 30))]
        places = spelling.Places(80)
        assert [c for c in every if places.take(c[1], c[2])] == brute_placed(every)


def test_many_occurrences_cost_in_proportion():
    def seconds(n):
        text = "ana paz " * n
        pieces = [[0] + [len("ana paz ") - 3] * (n - 1), [4] + [len("ana paz ") - 3] * (n - 1)]
        begin = time.process_time()
        got = spelling.placed(text, ["ana", "paz"], pieces)
        assert len(got) == 2 * n
        return time.process_time() - begin

    seconds(1000)
    assert seconds(32_000) < 6 * max(seconds(8_000), .02)


def test_any_page_of_many_texts_and_pages(spark):
    """More texts than one list holds, over pages that have few of them, literally or spelled; nulls and empty texts find nothing."""
    random.seed(6)
    pages = [(d, p, " ".join(f"w{random.randint(0, 4000)}" for _ in range(40))) for d in (1, 2) for p in range(30)] + [(1, 99, None), (3, 1, "")]
    needles = [(1, 5, i, f"W{i}" if i % 2 else f"w{i}") for i in range(2500)] + [(1, 5, 9000, None), (1, 5, 9001, ""), (2, 1, 1, "w1 - w2"), (4, 1, 0, "x")]
    ents = spark.createDataFrame(needles, "doc_id int, page int, ord int, text string")
    got = {(r.doc_id, r.ord): r.found_page for r in locate.locate_any_page(ents, spark.createDataFrame(pages, "doc_id int, page int, text string")).collect()}
    want = {}
    for d, _, i, text in needles:
        hit = [p for e, p, t in pages if e == d and t and text and (text in t or brute_runs(t.split(), [text]))]
        if hit:
            want[d, i] = min(hit)
    assert got == want


def test_runs_carry_their_words(spark):
    words = spark.createDataFrame([(1, 1, i, w, i * 1.0) for i, w in enumerate(["José", "-", "Luis", "Paz", "jose", "luis"])], "doc_id int, page int, word_ord int, text string, x0 double")
    ents = spark.createDataFrame([(1, 1, 0, "jose luis"), (1, 1, 1, "JOSE"), (1, 1, 2, None), (2, 1, 0, "x")], "doc_id int, page int, ord int, text string")
    rows = locate.locate_tolerant(ents, words, ["x0"]).orderBy("ord", "occurrence").collect()
    assert [(r.ord, r.occurrence, r.first_word, r.last_word, [w.text for w in r.run], r.run[0].x0) for r in rows] == [
        (0, 0, 0, 2, ["José", "-", "Luis"], 0.0), (0, 1, 4, 5, ["jose", "luis"], 4.0), (1, 0, 0, 0, ["José"], 0.0), (1, 1, 4, 4, ["jose"], 4.0)]
    assert locate.locate_tolerant(ents.limit(0), words).count() == 0


def test_occurrences_of_any_case_and_spelling(spark):
    text = "Ana Paz, ANA PAZ y anapaz. ßana"
    rows = [(1, 1, 0, "N", 0, 3, "ana paz", "regex", .9), (1, 1, 1, "M", 0, 3, "ana", "regex", .9), (1, 1, 2, "X", 0, 3, None, "regex", .9)]
    ents = spark.createDataFrame(rows, "doc_id int, page int, ord int, type string, start_offset int, end_offset int, text string, source string, confidence double")
    pages = spark.createDataFrame([(1, 1, text), (1, 2, None)], "doc_id int, page int, text string")
    got = {r.page: r for r in locate.mask_occurrences(pages, ents).collect()}
    assert [(c.ord, c.type, c.start_offset, c.end_offset, c.text) for c in got[1].occurrences] == [
        (0, "N", 0, 7, "Ana Paz"), (1, "N", 9, 16, "ANA PAZ"), (2, "M", 19, 22, "ana"), (3, "M", 28, 31, "ana")]
    assert got[1].occurrences_masked == 4 and got[2].occurrences_masked == 0
    assert locate.mask_occurrences(pages, ents.filter(F.lit(False))).filter("occurrences_masked > 0").count() == 0

"""Boxes by grid, against all pairs; very long pages of a model."""

import random

from tachado.operators import geometry, model

BOX = "doc_id int, page int, box_ord int, x0 double, y0 double, x1 double, y1 double"
SPAN = "doc_id int, page int, span_ord int, x0 double, y0 double, x1 double, y1 double, size double"


def shared(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def area(b):
    return abs((b[2] - b[0]) * (b[3] - b[1]))


def random_box(rng, size=30):
    x, y = rng.choice([0.0, rng.uniform(-50, 300)]), rng.uniform(0, 300)
    return (x, y, x + rng.choice([0, rng.uniform(-2, size), 250]), y + rng.uniform(0, size))


def brute_kept(boxes, threshold):
    kept, out = [], []
    for b in boxes:
        covered = area(b) > 0 and any(shared(b, k) > 0 and shared(b, k) >= min(area(b), area(k) or area(b)) * threshold for k in kept)
        out.append(not covered)
        if not covered:
            kept.append(b)
    return out


def brute_size(box, spans):
    best, size = 0.0, 0.0
    for _, *corners, s in sorted(spans):
        if s and shared(corners, box) > best:
            best, size = shared(corners, box), s
    return size


def test_stacked_boxes_against_all_pairs():
    rng = random.Random(1)
    for n in [0, 1, 2, 5, 40, 150] * 10:
        boxes = [random_box(rng) for _ in range(n)]
        boxes += rng.sample(boxes, min(3, n))
        assert geometry.unstacked(boxes, .5) == brute_kept(boxes, .5)
    assert geometry.unstacked([(0, 0, None, 1), (0, 0, float("nan"), 1), (0, 0, 1, 1), (0, 0, 1, 1)]) == [True, True, True, False]


def test_font_sizes_against_all_pairs(spark):
    rng = random.Random(2)
    boxes = [(d, 1, i, *random_box(rng)) for d in (1, 2) for i in range(120)] + [(3, 1, 0, 1., 1., 2., 2.), (1, 1, 500, None, 1., 2., 2.)] + [(1, 1, 501, 0., 0., 5., 5.)] * 2
    spans = [(d, 1, i, *random_box(rng, 90), rng.choice([0.0, 9.0, 11.0, 12.5])) for d in (1, 2) for i in range(60)] + [(1, 1, 900, -1e7, 0., 1e7, 1., 3.0), (1, 1, 901, 0., 0., None, 1., 8.0)]
    got = sorted(((r.doc_id, r.box_ord, r.font_size) for r in geometry.font_size(spark.createDataFrame(boxes, BOX), spark.createDataFrame(spans, SPAN)).collect()))
    want = sorted((d, i, 0.0 if None in b else brute_size(b, [s[2:] for s in spans if s[0] == d and None not in s])) for d, _, i, *b in boxes)
    assert got == want


def test_ten_thousand_boxes_on_a_page(spark):
    rows = [(1, 1, i, float(i % 100) * 6, float(i // 100) * 8, float(i % 100) * 6 + 5, float(i // 100) * 8 + 7) for i in range(10_000)]
    boxes = spark.createDataFrame(rows + [(1, 1, 10_000 + i, *r[3:5], r[5] - 1, r[6]) for i, r in enumerate(rows[:500])], BOX)
    assert geometry.dedup_boxes(boxes).count() == 10_000
    spans = spark.createDataFrame([(*r, float(r[2] % 7 + 1)) for r in rows], SPAN)
    assert geometry.font_size(boxes, spans).filter("font_size <> box_ord % 10000 % 7 + 1").count() == 0


def test_thousands_of_windows_on_a_page(spark):
    names = [f"Ana {chr(65 + i % 26)}ez{'abcdefghij'[i % 10]}" for i in range(3000)]
    text = " ".join(n + " y luego" + " x" * 4 for n in names)
    pages = spark.createDataFrame([(1, 1, text)], "doc_id int, page int, text string")
    windows = model.build_prompt(model.prompt_windows(pages, 40, 20))
    assert windows.count() > 3000
    found = model.locate_in_windows(model.score_pages(windows, model.capitalized_names_scorer)).orderBy("ord").collect()
    assert [r.ord for r in found] == list(range(len(found)))
    assert [(r.start_offset, r.text) for r in found] == sorted((r.start_offset, r.text) for r in found)
    assert len({(r.start_offset, r.end_offset) for r in found}) == len(found) > 2500

"""Rules per user on large batches: what Python holds of a batch."""

import json
import tracemalloc

import pyarrow as pa

from tachado.operators import detect


def test_a_batch_costs_little_beyond_its_own_bytes():
    rules = json.dumps([{"pattern": r"[a-z]+@b\.co", "required": ["@"]}, {"pattern": r"(\d)\1{3,}"}])
    texts = pa.array([None, "ana@b.co 1111", *["x" * 4000] * 8000])
    both = pa.array([rules, rules, *[rules] * 7999, None])
    tracemalloc.start()
    (got,) = detect._user_spans.func(iter([(texts, both)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes / 4
    assert got[0].as_py() is None and got[8001].as_py() is None and got[2].as_py() == [[], []]
    assert got[1].as_py() == [[{"start_offset": 0, "end_offset": 8, "text": "ana@b.co"}], [{"start_offset": 9, "end_offset": 13, "text": "1111"}]]


def test_users_with_odd_rules(spark):
    """Patterns travel as text: quotes, backslashes, letters outside ASCII; users without rules, rules without users, nulls."""
    pages = spark.createDataFrame([(1, 1, 'a "é\\" 77', "u"), (2, 1, "77", "none"), (3, 1, None, "u"), (4, 1, "77", None), (5, 1, "", "u")],
                                  "doc_id int, page int, text string, user_id string")
    rules = spark.createDataFrame([("u", 0, "Q", r'"é\\"', True), ("u", 1, "R", r"(\d)\1", None), ("u", 2, "S", "([", True), ("gone", 0, "R", "7", True)],
                                  "user_id string, rule_idx int, type string, pattern string, enabled boolean")
    got = {r.doc_id: [(c.ord, c.type, c.start_offset, c.end_offset, c.text) for c in r.candidates] for r in detect.user_candidates(pages, rules).collect()}
    assert got == {1: [(0, "Q", 2, 6, '"é\\"'), (1, "R", 7, 9, "77")], 2: [], 3: [], 4: [], 5: []}

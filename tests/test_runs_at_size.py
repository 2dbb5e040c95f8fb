"""Words of many pages: what Python holds of a batch."""

import tracemalloc

import pyarrow as pa

from tachado.functions import spelling


def test_a_batch_of_pages_costs_little_beyond_its_own_bytes():
    pages = [None, ["ana", "paz"], *[["w" * 60] * 100] * 5000]
    words, targets = pa.array(pages, pa.list_(pa.string())), pa.array([["x"], ["anapaz", None], *[["y"]] * 5000], pa.list_(pa.string()))
    tracemalloc.start()
    got = spelling.page_runs.func(words, targets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < words.nbytes / 4
    assert len(got) == 5002 and got[0].as_py() == [] and got[1].as_py() == [{"target": 0, "occurrence": 0, "first": 0, "last": 1}]
    assert len(spelling.page_runs.func(words.slice(0, 0), targets.slice(0, 0))) == 0

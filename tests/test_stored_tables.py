"""Stored tables by bucket, the ledger of batches, and status and settings kept in them."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tachado.operators import config, observe
from tachado.operators import status as st
from tachado.sources import buckets
from tachado.streaming import flows

T0 = datetime(2024, 1, 1)
EVENTS = "user_id string, document_id string, ts timestamp, seq bigint, op string, status string, entities_found bigint, entities_by_type map<string,int>"


def source(spark, tmp_path, batches, schema):
    """A stream of one micro-batch per list of rows."""
    at = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def random_events(n, seed):
    random.seed(seed)
    return [(random.choice("uv"), random.choice("abcd"), T0 + timedelta(minutes=random.randint(0, 30)), i, random.choice(["put", "update", "update"]),
             random.choice([None, "PROCESSING", "COMPLETED"]), random.choice([None, i]), random.choice([None, {"DNI": i}])) for i in range(n)]


def rows_of(df):
    return sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r) for r in df.collect()), key=repr)


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    at, merge = str(tmp_path / "t"), buckets.newest(["k"], ["v"])
    frame = lambda rows: spark.createDataFrame(rows, "k bigint, v bigint")
    with pytest.raises(FileNotFoundError):
        buckets.read(spark, at)
    assert buckets.upsert(frame([(i, 0) for i in range(100)]), at, ["k"], merge, 8) == 1
    first = buckets.manifest(spark, at)
    assert buckets.upsert(frame([(5, 7), (5, 3)]), at, ["k"], merge) == 2
    second = buckets.manifest(spark, at)
    changed = [b for b in range(8) if first.folders.get(b) != second.folders.get(b)]
    assert len(changed) == 1 and second.buckets == 8
    assert rows_of(buckets.read(spark, at)) == sorted(((i, 7 if i == 5 else 0) for i in range(100)), key=repr)
    assert buckets.read(spark, at, 1).filter("v > 0").count() == 0

    def broken(rows):
        return rows.withColumn("v", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        buckets.upsert(frame([(6, 9)]), at, ["k"], broken)
    assert buckets.manifest(spark, at) == second
    assert buckets.upsert(frame([(6, 9)]), at, ["k"], merge, batch=4) == 3
    assert buckets.upsert(frame([(6, 1), (7, 99)]), at, ["k"], merge, batch=4) == 3  # the same batch again
    assert {r.k: r.v for r in buckets.read(spark, at).filter("v > 0").collect()} == {5: 7, 6: 9}
    with pytest.raises(FileExistsError):
        buckets.Folder(spark, f"{at}/manifests").put("00000003.json", "{}")
    assert buckets.upsert(frame([]), at, ["k"], merge) == 4 and buckets.read(spark, at).count() == 100


def test_two_saves_are_one_configuration(spark, tmp_path):
    good = ("true", "false", "m", "0.5", "ver {text}", [("A", "a", True)], ["x"])
    schema = ("user_id string, method string, residual_scan string, alerts string, model_id string, temperature string, prompt string, "
              "rules array<struct<type:string,pattern:string,enabled:boolean>>, ignored array<string>")
    at = str(tmp_path / "c")
    for method, who in (("ai", "uvw"), ("regex", "v"), ("magic", "u"), ("both", "xx")):
        config.save_config(spark.createDataFrame([(u, method, *good) for u in who], schema), at)
    stored = config.read_config(spark, at)
    assert {(r.user_id, r.method) for r in stored.collect()} == {("u", "ai"), ("v", "regex"), ("w", "ai"), ("x", "both")} and stored.count() == 4
    docs = spark.createDataFrame([(1, "v"), (2, "v"), (3, "nobody")], "doc_id int, user_id string")
    assert sorted((r.doc_id, r.method) for r in config.with_config(docs, stored).collect()) == [(1, "regex"), (2, "regex"), (3, "both")]


def test_status_parts_add_up_in_any_order(spark, tmp_path):
    events = spark.createDataFrame(random_events(300, 1), EVENTS)
    want = rows_of(st.latest_status(events))
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        at = str(tmp_path / f"s{order}")
        for part in order:
            st.put_status(events.filter(F.col("seq") % 3 == part), at, buckets_of=4)
        assert rows_of(st.stored_status(spark, at)) == want


def test_status_stream_equals_batch(spark, tmp_path):
    rows = random_events(200, 2)
    late_first = [rows[120:], rows[:60], rows[60:120]]
    stream = source(spark, tmp_path, late_first, EVENTS)
    at = str(tmp_path / "table")
    flows.status_to_table(stream, at, str(tmp_path / "cp"), buckets_of=4).awaitTermination()
    assert rows_of(st.stored_status(spark, at)) == rows_of(st.latest_status(spark.createDataFrame(rows, EVENTS)))
    assert buckets.manifest(spark, at).batch == 2
    # The checkpoint is lost, so all batches come again under their numbers.
    flows.status_to_table(stream, at, str(tmp_path / "cp2"), buckets_of=4).awaitTermination()
    assert buckets.manifest(spark, at).version == 3


def test_a_failed_sink_is_replayed_alone(spark, tmp_path):
    pages = source(spark, tmp_path, [[(1, 1, "31.222.333")], [(2, 1, "30.111.222"), (3, 1, None)]], "doc_id int, page int, text string")
    calls, fail = [], [True]

    def sink(name):
        def write(rows, number):
            calls.append((name, number))
            if name == "entities" and number == 1 and fail:
                fail.clear()
                raise OSError("away")
            rows.write.mode("append").parquet(str(tmp_path / name))  # appends, so a second writing would show
        return write

    def run():
        flows.mask_to_sinks(pages, {n: sink(n) for n in ("masked", "entities", "failed")}, str(tmp_path / "cp")).awaitTermination()
    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert calls.count(("masked", 1)) == 1 and calls.count(("entities", 1)) == 2 and calls.count(("failed", 1)) == 1
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "masked")).collect()) == [1, 2]
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "entities")).collect()) == [1, 2]
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == [3]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 101, 5000])
@pytest.mark.parametrize("accuracy", [50, 10000])
def test_percentile_by_one_path(spark, n, accuracy):
    rng = np.random.default_rng(n)
    for values in (rng.exponential(10, n), rng.integers(0, 5, n).astype(float), np.full(n, 2.5), np.concatenate((np.zeros(n - 1), [1e300]))):
        df = spark.createDataFrame([(T0, "a", float(v)) for v in values] + [(T0, "b", None), (T0, "c", -1.0)], "ts timestamp, name string, value double")
        got = {r.name: r.p99 for r in observe.latency_p99(df, accuracy=accuracy).collect()}
        assert got == {"a": pytest.approx(float(np.quantile(values, 0.99)), rel=1e-9), "c": -1.0}

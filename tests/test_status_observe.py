import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tachado.operators import aggregate, observe, residual
from tachado.operators import status as st
from tachado.plans import corpus

T0 = datetime(2024, 1, 1)
EVENT = "user_id string, document_id string, ts timestamp, seq bigint, op string, status string, entities_found bigint, error_step string, engine string, key_masked string"


def by_hand(events):
    """Rows of a key/value store: put replaces, update overlays what it carries."""
    rows = {}
    for e in sorted(events, key=lambda e: (e[2], e[3])):
        key, values = e[:2], e[5:]
        if e[4] == "put":
            rows[key] = list(values)
        else:
            row = rows.setdefault(key, [None] * len(values))
            for i, v in enumerate(values):
                if v is not None:
                    row[i] = v
    return rows


def random_events(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice("uv"), rnd.choice("abcd"), T0 + timedelta(minutes=rnd.randrange(50)), i, rnd.choice(["put", "update", "update"]),
             rnd.choice([None, "PROCESSING", "COMPLETED", "FAILED"]), rnd.choice([None, 0, 3]), rnd.choice([None, "X"]), rnd.choice([None, "R"]), rnd.choice([None, "", "k"])) for i in range(n)]


@pytest.mark.parametrize("seed,n", [(1, 5), (2, 20), (3, 120)])
def test_status_fold(spark, seed, n):
    events = random_events(n, seed)
    df = spark.createDataFrame(events, EVENT)
    expected = by_hand(events)
    got = {(r.user_id, r.document_id): [r.status, r.entities_found, r.error_step, r.engine, r.key_masked] for r in st.latest_status(df).collect()}
    assert got == expected
    early = F.col("ts") < F.lit(T0 + timedelta(minutes=25))
    again = st.fold_stored(st.latest_status(df.filter(early)), df.filter(~early))
    assert {(r.user_id, r.document_id): [r.status, r.entities_found, r.error_step, r.engine, r.key_masked] for r in again.collect()} == expected


def test_tracking_progress(spark):
    status = spark.createDataFrame([("u", "a", "COMPLETED", "", 0), ("u", "b", "failed", None, None), ("u", "c", "PROCESSING", None, None)], "user_id string, document_id string, status string, key_masked string, entities_found int")
    asked = spark.createDataFrame([("u", x, "PENDING") for x in "abcd"], "user_id string, document_id string, previous string")
    t = st.track(asked, status)
    assert {r.document_id: (r.state, r.masked_state) for r in t.collect()} == {"a": ("COMPLETED", "NONE"), "b": ("FAILED", "NONE"), "c": ("PROCESSING", "CREATING"), "d": ("PENDING", None)}
    assert tuple(st.progress(t).first()) == (2, 4, 50) and st.all_terminal(t).first()[0] is False
    assert tuple(st.progress(t.limit(0)).first()) == (0, 0, 0) and st.all_terminal(t.filter("document_id < 'c'")).first()[0] is True


def test_paging(spark):
    df = spark.createDataFrame([(f"d{i:02}", T0 + timedelta(hours=i // 3)) for i in range(50)], "document_id string, uploaded_at timestamp")
    seen, token = [], None
    while True:
        rows = st.next_page(df, token, 20).collect()
        seen += [r.document_id for r in rows]
        if len(rows) < 20:
            break
        token = st.page_token(rows[-1])
    assert seen == [f"d{i:02}" for i in reversed(range(50))]
    for bad in ("zz", "bm8=", "e30="):
        with pytest.raises(ValueError):
            st.next_page(df, bad)
    assert [r.document_id for r in st.page_of(st.sort_by(df, "document_id"), 3).collect()] == [f"d{i}" for i in range(40, 50)]
    assert tuple(st.page_count(df).first()) == (50, 3)


def test_purge_and_retention(spark):
    keys = ["originales/u/a", "ofuscados/u/a", "procesamiento/u/a", "errores/u/a", "originales/uu/a"]
    df = spark.createDataFrame([(k, T0) for k in keys], "key string, modified timestamp")
    for scope, gone in [("obfuscated", {1, 2}), ("originals", {0}), ("all", {0, 1, 2})]:
        keep, out = st.purge(df, "u", scope)
        assert {r.key for r in out.collect()} == {keys[i] for i in gone} and keep.count() == 5 - len(gone)
    with pytest.raises(ValueError):
        st.purge(df, "u", "x")
    kept = {r.key for r in st.apply_retention(df, T0 + timedelta(days=30, seconds=1)).collect()}
    assert kept == {keys[0], keys[1], keys[4]} and st.apply_retention(df, T0 + timedelta(days=30)).count() == 5


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000])
def test_exact_percentile_without_gathering(spark, n):
    rnd = random.Random(n)
    values = [round(rnd.expovariate(0.01), rnd.choice([0, 3])) for _ in range(n)]
    df = spark.createDataFrame([(T0, "a", v) for v in values], "ts timestamp, name string, value double")
    at = (n - 1) * 0.99
    s = sorted(values)
    expected = s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))
    for accuracy in (100, 10000):
        assert observe.latency_p99(df, accuracy=accuracy).first().p99 == pytest.approx(expected, rel=1e-12)


def test_alarms_letters_metrics(spark):
    rows = [(T0 + timedelta(seconds=i), "f", 1.0) for i in range(6)] + [(T0 + timedelta(minutes=6), "f", 5.0), (T0, "g", 4.0)]
    df = spark.createDataFrame(rows, "ts timestamp, name string, value double")
    got = {(r.window_start.minute, r.name): r.breaching for r in observe.error_alarms(df, thresholds={"g": 3}).collect()}
    assert got == {(0, "f"): True, (5, "f"): False, (0, "g"): True}
    bad = spark.createDataFrame([("{}", "x" * 3000, "INTAKE", "d", "u", T0, "ocr", "Throttled"), ("{}", None, None, "e", "u", T0, None, None), ("{}", "y", "DETECT", None, None, T0, None, "")],
                                "event string, error_message string, error_step string, document_id string, user_id string, ts timestamp, service string, error_type string")
    assert sorted(len(r.message) for r in observe.dead_letters(bad).collect()) == [1, 2048]
    points = [(r.name, r.dims) for r in observe.metric_points(bad.filter("error_message is not null")).collect()]
    assert points == [("ServiceInvocationError", {"ServiceName": "ocr", "ErrorType": "Throttled"}), ("PipelineError", {"ErrorStep": "DETECT"})]


def test_findings(spark):
    rows = [("a", "ofuscados/u/x", "b", "High", "CLASSIFICATION", 5), ("b", "originales/u/x", None, "", "CLASSIFICATION", 4), ("c", "originales/uu/x", "b", "Low", "CLASSIFICATION", 9), ("d", "originales/u/x", "z", "Raro", "CLASSIFICATION", 8), ("e", "originales/u/y", "b", "Raro", "POLICY", 7)]
    df = spark.createDataFrame([(*r[:5], T0 + timedelta(days=r[5])) for r in rows], "id string, key string, bucket string, severity string, category string, updated_at timestamp")
    assert {r.id: (r.scope, r.severity) for r in residual.scope_findings(df, "u", "b").collect()} == {"a": ("OFUSCADOS", "Alta"), "b": ("ORIGINALES", "—"), "e": ("ORIGINALES", "Raro")}
    assert [r.id for r in residual.top_findings(df, 1, "u", "b").collect()] == ["a"]


def test_residual_ignores_only_labels_put_there(spark):
    rules = [{"type": "P", "pattern": r"[A-Z]{2}\d{2,7}"}, {"type": "EMAIL", "pattern": r"[a-z]+@[a-z]+\.org"}]
    text = "AB123456 [CD1234567] (ana@x.org) [eva@x.org] [TOKEN_AB12-R] ZZ99"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, "nada")], "doc_id int, page int, text string")
    masked = corpus.mask_pages(pages, [{"type": "TOKEN_AB12", "pattern": r"AB\d+|ZZ\d+"}])
    assert masked.first().masked_text == "[TOKEN_AB12-R] [CD1234567] (ana@x.org) [eva@x.org] [TOKEN_[TOKEN_AB12-R]-R] [TOKEN_AB12-R]"
    assert sorted(r.text for r in residual.residual_scan(masked, rules).collect()) == ["CD1234567", "ana@x.org", "eva@x.org"]


def test_engine_labels(spark):
    docs = spark.createDataFrame([(i, "us.anthropic.claude-haiku-4-5-20251001-v1:0") for i in range(4)], "doc_id int, model_id string")
    ents = spark.createDataFrame([(0, "regex"), (1, "bedrock"), (1, "regex"), (2, "otro")], "doc_id int, source string")
    got = {r.doc_id: r.engine for r in aggregate.engine_label(docs, ents).collect()}
    assert got == {0: "Regex", 1: "IA (Claude Haiku 4.5) + Regex", 2: "IA (Claude Haiku 4.5)", 3: "IA (Claude Haiku 4.5)"}
    assert {r.doc_id: (r.bedrock, r.regex) for r in aggregate.source_contributions(ents).collect()} == {0: (0, 1), 1: (1, 1), 2: (0, 0)}

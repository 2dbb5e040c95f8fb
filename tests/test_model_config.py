import json

import pytest
from pyspark.sql import functions as F

from tachado import constants as K
from tachado.functions import display, identity, text as T
from tachado.operators import config, model
from tachado.plans import corpus

ANA = '[{"text":"Ana","type":"nombre","start_offset":0}]'
RESPONSES = [
    (ANA, "Ana vive", [("NOMBRE", 0, 3)]),
    ("Claro: " + ANA + " listo.", "Ana vive", [("NOMBRE", 0, 3)]),
    ('{"entities": []}', "Ana vive", []),
    ('{"entities": ' + ANA + "}", "Ana vive", [("NOMBRE", 0, 3)]),
    ("sin corchetes", "Ana vive", []),
    ("[1] y [2]", "Ana vive", []),
    (ANA + " x", "Ana vive", [("NOMBRE", 0, 3)]),
    ('["x", 42, null, {"text":"Ana","type":"NOMBRE","start_offset":0}]', "Ana vive", [("NOMBRE", 0, 3)]),
    ('[{"text":"Ana","type":"NOMBRE","start_offset":-1},{"text":"Ana","type":"NOMBRE","start_offset":"0"},{"text":"Ana","type":"NOMBRE","start_offset":1.5}]', "Ana vive", [("NOMBRE", 0, 3)] * 3),
    ('[{"text":"Ana Paz","type":"NOMBRE","start_offset":50}]', "Hola mundo, Ana Paz aquí", [("NOMBRE", 12, 19)]),
    ('[{"text":"Ana","type":"NOMBRE","start_offset":25}]', "Ana está aquí. Más texto. Ana otra vez.", [("NOMBRE", 26, 29)]),
    ('[{"text":"ana","type":"NOMBRE"}]', "x Ana", [("NOMBRE", 2, 5)]),
    ('[{"text":"Eva","type":"NOMBRE"}]', "Ana vive", []),
    ('[{"text":7,"type":"NOMBRE"}]', "Ana 7", []),
    ('[{"text":"Ana","type":"RARO"}]', "Ana", []),
    ('[{"text":"  ","type":"DNI"}]', "Ana  ", []),
    ('[{"text":" Ana ","type":"dni"}]', "x Ana", [("DNI", 2, 5)]),
    (None, "Ana", []),
]


def test_answers_become_located_entities(spark):
    rows = [(i, 1, t, r) for i, (r, t, _) in enumerate(RESPONSES)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, response string")
    got = {}
    for r in model.locate_entities(df).orderBy("ord").collect():
        got.setdefault(r.doc_id, []).append((r.type, r.start_offset, r.end_offset))
        assert r.text == RESPONSES[r.doc_id][1][r.start_offset:r.end_offset]
        assert (r.source, r.confidence) == ("bedrock", 0.85)
    for i, (response, text, expected) in enumerate(RESPONSES):
        assert got.get(i, []) == expected, response


@pytest.mark.parametrize("text,needle", [("aaaa", "aa"), ("abcab", "ab"), ("", "a"), ("x", ""), ("a.c.c", ".c"), ("😀a😀a", "a"), ("q\\Eq", "\\E"), ("abc", "abcd")])
def test_find_all_counts_overlapping_places(spark, text, needle):
    expected = [i for i in range(len(text)) if needle and text.startswith(needle, i)]
    assert spark.range(1).select(model.find_all(F.lit(text), F.lit(needle))).first()[0] == expected


def test_prompts(spark):
    df = spark.createDataFrame([(1, "x" * 3)], "doc_id int, text string")
    assert model.build_prompt(df, "a {text} b {text}").first().prompt == "a xxx b xxx"
    assert model.build_prompt(df, "sin").first().prompt == "sin\n\nTEXTO A ANALIZAR:\n---\nxxx\n---"
    blank = model.build_prompt(df, " \n").first()
    assert blank.prompt is None and blank.prompt_error


def test_names_far_into_a_page_are_found(spark):
    text = "x" * 9_990 + " Ana Paz " + "y " * 5_000 + "Eva Sol"
    df = spark.createDataFrame([(1, 1, text), (2, 1, ""), (3, 1, None), (4, 1, "Luz Mar")], "doc_id int, page int, text string")
    answered = df.filter("doc_id = 1").withColumn("response", F.lit(json.dumps([{"text": "Eva Sol", "type": "NOMBRE", "start_offset": 0}])))
    assert [r.start_offset for r in model.locate_entities(answered).collect()] == [text.index("Eva Sol")]
    windows = model.prompt_windows(df, 10_000, 500).collect()
    for doc, own in ((1, text), (2, ""), (4, "Luz Mar")):
        seen = set()
        for w in windows:
            if w.doc_id == doc:
                assert w.text == own[w.window_start:w.window_start + 10_000] and w.page_chars == len(own)
                seen |= set(range(w.window_start, w.window_start + len(w.text)))
        assert seen == set(range(len(own)))
    scored = model.score_pages(model.build_prompt(model.prompt_windows(df.na.fill(""), 50, 20)), model.capitalized_names_scorer)
    found = model.locate_in_windows(scored).collect()
    assert sorted((r.doc_id, r.text, r.start_offset) for r in found) == [
        (1, "Ana Paz", text.index("Ana Paz")), (1, "Eva Sol", text.index("Eva Sol")), (4, "Luz Mar", 0)]
    assert sorted(r.ord for r in found if r.doc_id == 1) == [0, 1]


def test_one_bad_page_leaves_the_others(spark):
    def scorer(frame):
        if (frame["text"] == "mal").any():
            raise RuntimeError("no")
        return frame["text"].map(lambda t: "" if t == "vacio" else json.dumps([{"text": t, "type": "NOMBRE"}]))
    df = spark.createDataFrame([(1, 1, "Ana"), (2, 1, "mal"), (3, 1, "vacio"), (4, 1, "Eva")], "doc_id int, page int, text string").coalesce(1)
    out = model.score_pages(model.build_prompt(df), scorer, temperature=3.0)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].response is None and "RuntimeError" in rows[2].model_error
    assert rows[3].response is None and rows[3].model_error == "empty answer"
    assert rows[1].temperature == 1.0
    assert sorted(r.doc_id for r in model.locate_entities(out).collect()) == [1, 4]


def test_whole_page_plan_with_settings(spark):
    rows = [(1, 1, "Ana Paz 31.222.333 a@b.org", "both", ["a@B.org "], {"DNI": True}),
            (2, 1, "Ana Paz 31.222.333 a@b.org", "ai", None, None),
            (3, 1, "Ana Paz 31.222.333 a@b.org", "regex", None, {"DNI": False}),
            (4, 1, "Ana Paz 31.222.333 a@b.org", "magic", None, None)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, method string, ignored array<string>, active_types map<string,boolean>")
    df = df.withColumn("response", F.lit('[{"text":"Ana Paz","type":"NOMBRE"}]'))
    got = {r.doc_id: r.masked_text for r in corpus.mask_pages(df).collect()}
    assert got == {1: "[NOMBRE-IA] [DNI-R] a@b.org", 2: "[NOMBRE-IA] 31.222.333 a@b.org", 3: "Ana Paz 31.222.333 [EMAIL-R]", 4: rows[3][2]}


GOOD = dict(method="both", residual_scan="false", alerts="true", model_id="m", temperature="0", prompt="ver {text}", rules=[("A", "a", True)], ignored=["x"])
BAD = [
    ({}, ""), ({"method": None}, ""), ({"method": "magic"}, "unknown_method"), ({"residual_scan": "si"}, "residual_scan_not_boolean"),
    ({"temperature": "-0.1"}, "temperature_out_of_range"), ({"temperature": "1"}, ""), ({"temperature": "1.1"}, "temperature_out_of_range"),
    ({"temperature": "true"}, "temperature_not_a_number"), ({"prompt": " "}, "prompt_blank"), ({"prompt": "x"}, "prompt_without_slot"),
    ({"prompt": "{text}" + "x" * 19995}, "prompt_too_long"), ({"rules": [("A", "a", True)] * 51}, "too_many_rules"),
    ({"rules": [("A", "a" * 501, True)]}, "pattern_too_long"), ({"rules": [("A", "a" * 500, True)]}, ""), ({"rules": [(" ", "a", True)]}, "rule_without_type"),
    ({"rules": [("A", "", True)]}, "rule_without_pattern"), ({"rules": [("A", "([", True)]}, "pattern_does_not_compile"),
    ({"rules": [("A", "a", False)]}, "no_active_rule"), ({"rules": [("A", "a", False)], "method": "ai"}, ""), ({"rules": [("A", "a", None)]}, ""),
    ({"ignored": ["x"] * 201}, "too_many_ignored"), ({"ignored": ["x" * 201]}, "ignored_too_long"), ({"model_id": ""}, "model_missing"),
]


def test_first_problem_of_a_configuration(spark):
    rows = [(i, *{**GOOD, **change}.values()) for i, (change, _) in enumerate(BAD)]
    df = spark.createDataFrame(rows, "i int, method string, residual_scan string, alerts string, model_id string, temperature string, prompt string, "
                                     "rules array<struct<type:string,pattern:string,enabled:boolean>>, ignored array<string>")
    for r in config.validate_config(df).collect():
        assert (r.message, r.valid) == (BAD[r.i][1], BAD[r.i][1] == ""), BAD[r.i]


def test_config_round_trip_and_defaults(spark, tmp_path):
    rows = [("u", "ai", "true", "true", "m", "0.5", "ver {text}", [("A", "a", True)], ["x"]), ("v", "magic", "true", "true", "m", "0.5", "ver {text}", [("A", "a", True)], [])]
    df = spark.createDataFrame(rows, "user_id string, method string, residual_scan string, alerts string, model_id string, temperature string, prompt string, "
                                     "rules array<struct<type:string,pattern:string,enabled:boolean>>, ignored array<string>")
    config.save_config(df, str(tmp_path / "c"))
    stored = config.read_config(spark, str(tmp_path / "c"))
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    got = {r.user_id: r for r in config.resolve_config(users, stored).collect()}
    assert (got["u"].method, got["u"].temperature, len(got["u"].rules)) == ("ai", 0.5, 1)
    assert (got["v"].method, got["v"].temperature, len(got["v"].rules)) == ("both", 0.0, len(K.DEFAULT_RULES))
    assert [r.user_id for r in config.residual_enabled(stored).collect()] == ["u"]


def test_scalar_helpers(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]
    lit = F.lit
    claims = [("ana+x@a.org", "", "s", "ana"), ("Ana@b.org", "", "s", "ana"), ("", "idp_bob", "s", "bob"), (None, "bob", "s", "bob"), (None, None, "s", "s"), ("+x@a", "u", "s", "u")]
    for e, n, s, expected in claims:
        assert one(identity.user_from_claims(lit(e).cast("string"), lit(n).cast("string"), lit(s))) == expected
    for x, expected in [(None, "—"), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1048576, "1.00 MB"), (5000000, "4.77 MB")]:
        assert one(display.human_bytes(lit(x).cast("bigint"))) == expected
    for x, expected in [(None, "—"), (999, "999 ms"), (1000, "1.0 s"), (1150, "1.1 s"), (1250, "1.3 s"), (59999, "60.0 s"), (60000, "1m 0s"), (119600, "1m 60s"), (90500, "1m 31s")]:
        assert one(display.human_duration(lit(x).cast("bigint"))) == expected, x
    for x, expected in [("us.anthropic.claude-haiku-4-5-20251001-v1:0", "Claude Haiku 4.5"), ("anthropic.claude-3-5-haiku-20241022-v1:0", "Claude 3.5 Haiku"), ("amazon.nova", "amazon.nova")]:
        assert one(T.model_label(lit(x))) == expected
    for x, expected in [("ADRIÁN", "adrian"), ("+54 9 11", "54911"), ("ﬁn", "fin"), ("º°", "o"), ("", ""), ("Ñandú-(x)", "nandux")]:
        assert one(T.normalize_text(lit(x))) == expected
    assert one(T.key_parent(lit("a/b/c"))) == "a/b/" and one(T.key_name(lit("a/b/c"))) == "c" and one(T.key_name(lit("a/"))) == "a/"
    assert one(T.account_suffix(lit("x-docs-123"))) == "123" and one(T.account_suffix(lit("x-docs"))) == ""
    assert one(display.severity_label(lit("High"))) == "Alta" and one(display.severity_label(lit(""))) == "—" and one(display.severity_label(lit("Z"))) == "Z"
    assert one(display.clamp01(lit(-3))) == 0.0 and one(identity.session_tag(lit("abc"))) == "ba7816bf"
    assert one(T.safe_name(lit("a b/ñ.pdf"))) == "a-b---pdf"


def test_idempotent_rule_and_prompt(spark):
    df = spark.createDataFrame([("u", [("A", "a", True)], "antes INSTRUCCIONES: x INSTRUCCIONES: y"), ("v", None, "nada")], "user_id string, rules array<struct<type:string,pattern:string,enabled:boolean>>, prompt string")
    once = config.add_rule(config.add_rule(config.add_rule(df, "B", "b"), "B", "b"), "A", "a")
    assert {r.user_id: len(r.rules) for r in once.collect()} == {"u": 2, "v": 2}
    lined = config.add_prompt_line(config.add_prompt_line(df, "- B", "- B"), "- B", "- B")
    assert {r.user_id: r.prompt for r in lined.collect()} == {"u": "antes - B\n\nINSTRUCCIONES: x INSTRUCCIONES: y", "v": "nada\n\n- B"}

from tachado.functions import patterns
from tachado.operators import detect


def test_plain_words_are_stated_as_the_study_states_them(spark):
    words = ["abc", "a.b", ".ab", "...", "7a..b9", "A", "x*", "([a", "a b", "\\d{3}", "é", "a\n", "a?", ""]
    rows = [(i, "T", w, None) for i, w in enumerate(words)]
    got = {r.pattern: (r.jvm, r.required) for r in detect.usable_rules(spark.createDataFrame(rows, "rule_idx int, type string, pattern string, enabled boolean")).collect()}
    stated = {w: patterns.to_jvm(w) for w in words if detect.usable({"type": "T", "pattern": w, "enabled": None})}
    assert got == {w: (j.pattern, list(j.required)) for w, j in stated.items()}


def test_patterns_are_studied_once(spark):
    """Python sees distinct patterns only, and no plain words."""
    rules = spark.range(50).selectExpr("cast(id as int) rule_idx", "'T' type", "if(id % 2 = 0, 'word', concat('a{', id % 3 + 1, '}')) pattern", "true enabled")
    plan = detect.usable_rules(rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate [")

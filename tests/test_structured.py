"""Structured output: every kind of fault, repairs, failures as rows."""

from pyspark.sql import functions as F

from scriptorium.operators import structured


def test_faults_of_every_kind(spark):
    raws = [
        ("good", '{"question": "why", "explanation": "because", "more": 1}'),
        ("fenced", '```json\n{"question": "why", "explanation": "because"}\n```'),
        ("null", None),
        ("blank", "  "),
        ("words", "no idea"),
        ("cut", '{"question": "why", "expl'),
        ("type", '{"question": {"a": 1}, "explanation": 5}'),
        ("hole", '{"question": "why"}'),
        ("empty", '{"question": "", "explanation": "because"}'),
    ]
    rows = spark.createDataFrame(raws, "name string, raw string")
    checks = {"empty_stem": lambda v: F.trim(v["question"]) != ""}
    got = {r["name"]: r for r in structured.parsed(rows, structured.STEM, checks).collect()}
    faults = {n: [x["check"] for x in r["faults"]] for n, r in got.items()}
    assert {n for n, f in faults.items() if not f} >= {"good", "fenced"}
    assert faults["null"] == faults["blank"] == ["no_answer"]
    assert faults["words"] == faults["cut"] == ["malformed"]
    assert faults["hole"] == ["missing"] and got["hole"]["faults"][0]["detail"] == "explanation"
    assert faults["empty"] == ["empty_stem"]
    assert got["good"]["value"]["explanation"] == "because" and got["hole"]["value"] is None
    loose = {r["name"]: r for r in structured.parsed(rows, structured.STEM, checks, optional=["explanation"]).collect()}
    assert loose["hole"]["faults"] == [] and loose["hole"]["value"]["question"] == "why"


def test_nested_holes(spark):
    rows = spark.createDataFrame([('{"cards": [{"front": "a", "back": "b"}, {"front": "c"}]}',), ('{"cards": []}',), ('{"cards": [null]}',)], "raw string")
    got = [len(r["faults"]) for r in structured.parsed(rows, structured.CARDS).collect()]
    assert got == [1, 0, 1]


class Stubborn:
    """Answers with what the prompt asks for, better when told of a fault; says how often it was asked."""

    asked = 0

    def generate(self, prompts):
        Stubborn.asked += prompts.count()
        again = F.col("prompt").contains("not accepted")
        good = F.lit('{"question": "q", "explanation": "e"}')
        return prompts.withColumn("raw", F.when(F.col("id") == 1, good).when((F.col("id") == 2) & again, good).otherwise(F.lit("no")))


def test_only_failing_rows_are_asked_again(spark):
    prompts = spark.createDataFrame([(1, "one", "x"), (2, "two", "y"), (3, "three", "z")], "id int, prompt string, tag string")
    good, failures = structured.generated(prompts, Stubborn(), structured.STEM, attempts=3)
    assert good.columns == ["id", "prompt", "tag", "value", "attempt"]
    assert sorted((r["id"], r["prompt"], r["attempt"]) for r in good.collect()) == [(1, "one", 1), (2, "two", 2)]
    assert sorted((r["id"], r["attempt"], r["check"], r["final"]) for r in failures.collect()) == [(2, 1, "malformed", False), (3, 1, "malformed", False), (3, 2, "malformed", False), (3, 3, "malformed", True)]
    assert Stubborn.asked == 3 + 2 + 1


def test_no_prompts(spark):
    good, failures = structured.generated(spark.createDataFrame([], "id int, prompt string"), Stubborn(), structured.STEM)
    assert good.collect() == [] and failures.collect() == []

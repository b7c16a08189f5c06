"""Model requests, settings and events."""

import json

import pytest
from pyspark.sql import functions as F

from triagelake import events, settings
from triagelake.operators import model


class Scripted:
    """Replies by what the prompt says."""

    def chat(self, messages, name):
        text = messages[0][1]
        if "boom" in text:
            raise RuntimeError("down")
        if "repair" in text:
            return '{"conclusion":"ok"}' if len(messages) > 2 else "prose {}"
        return '{"conclusion": " ", "confidence": 2}' if "odd" in text else '```json\n{"conclusion":"seen","confidence":0.7,"extra":1}\n```'


def test_parse():
    assert model.parse('{"a":1}') == {"a": 1} == model.parse('```JSON\n{"a":1}\n```') == model.parse('```\n{"a":1}\n  ```')
    for bad in ("", None, "x {}", "[1]", "```json {}```", "```py\n{}\n```", '{"a":1} {"b":2}', "```"):
        assert model.parse(bad) == {}


def test_forms():
    assert model.OBSERVATION.read({"role": "r", "conclusion": "c", "confidence": "7"})["confidence"] == 1.0
    assert model.OBSERVATION.read({"role": "r", "conclusion": "c", "confidence": "x"})["confidence"] == 0.5
    assert model.CHALLENGE.read({})["disposition"] == "confirmed"
    for form, bad in ((model.OBSERVATION, {"role": "r"}), (model.CHALLENGE, {"disposition": "x"}), (model.ANSWER, {"confidence": "x"}), (model.CHALLENGE, {"conflicts": "x"})):
        with pytest.raises(ValueError):
            form.read(bad)


def test_decisions(spark):
    rows = [("a", "plain"), ("b", "repair"), ("c", "odd"), ("d", "boom"), ("e", None), (None, "plain")]
    df = spark.createDataFrame(rows, "subject string, prompt string")
    got = model.decide(df, Scripted(), model.ANSWER, context={"run_id": "r"})
    by = {r.subject: r for r in got.collect()}
    assert [(by[s].status, by[s].attempts) for s in "abcde"] == [("completed", 1), ("completed", 2), ("unresolved_semantic", 2), ("unresolved_backend", 1), ("completed", 1)]
    assert json.loads(by["a"].decision) == {"conclusion": "seen", "rationale": "", "confidence": 0.7} and len(by["c"].errors) == 2 * 2 and by[None].status == "completed"
    again = {r.subject: (r.status, r.decision) for r in model.replayed(df, got, model.ANSWER, context={"run_id": "r"}).collect()}
    assert again["a"] == ("completed", by["a"].decision) and again["d"] == ("unresolved_replay_missing", None)
    assert model.decide(df.limit(0), Scripted(), model.ANSWER).count() == 0


@pytest.mark.parametrize("limit", [0, 5, 100])
def test_budget_is_a_ceiling(spark, limit):
    df = spark.range(40).select(F.col("id").cast("string").alias("subject"), F.lit("odd").alias("prompt"))
    rows = model.decide(df, Scripted(), model.ANSWER, limit=limit).collect()
    assert len(rows) == 40 and sum(r.attempts for r in rows) <= limit
    assert sum(model.share(17, i, 5) for i in range(5)) == 17
    with pytest.raises(ValueError):
        model.Budget(3).take(0)


def test_prompt_and_stop(spark):
    text = spark.range(1).select(model.prompt({"b": F.lit("x"), "a": F.lit(None).cast("string")})).first()[0]
    assert text == 'UNTRUSTED_EVIDENCE_JSON\n{"a":null,"b":"x"}\nEND_UNTRUSTED_EVIDENCE_JSON'
    assert [model.converged(*x)[1] for x in ((3, 3, 1, False), (1, 3, 1, True), (1, 3, 0, False), (1, 3, 1, False))] == ["max_iterations", "analysis_budget_exhausted", "no_unresolved_analysis", "unresolved_analysis_remains"]


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('[triagelake]\nmax_json_depth = 9\nbackend = "mock"\n')
    s = settings.load(str(path), {"TRIAGELAKE_MAX_JSON_DEPTH": "12", "TRIAGELAKE_MODEL": "m"})
    assert (s.max_json_depth, s.backend, s.model, s.repair_retries) == (12, "mock", "m", 1) and s.public()["max_json_depth"] == 12
    for bad in ({"max_json_depth": 0}, {"max_json_depth": True}, {"backend": "x"}, {"model": " "}, {"max_run_seconds": 10**9}):
        with pytest.raises(ValueError):
            settings.Settings(**bad)


def test_events(tmp_path):
    path = tmp_path / "e" / "events.jsonl"
    assert events.Events(str(path)).emit("a", "r", {"Access-Token": 1, "x": [{"password": 2}], "n": 1})["sequence"] == 1
    second = events.Events(str(path)).emit("b", "r")
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    assert second["sequence"] == 2 and lines[0]["payload"] == {"Access-Token": "[REDACTED]", "x": [{"password": "[REDACTED]"}], "n": 1}

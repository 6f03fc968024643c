"""Scoring, networks, prompts."""

import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventflow.operators import bayes, prompts, score
from eventflow.operators.prompts import ModelConfig


def doubling():
    return lambda rows: rows[:, 0] * 2


def fussy():
    def predict(rows):
        if (rows < 0).any():
            raise ValueError("negative")
        return rows.sum(axis=1)

    return predict


def vectors(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, x array<double>")


def test_one_result_per_row_in_order(spark):
    df = score.score(vectors(spark, [[float(i), 0.0] for i in range(100)]), "x", 2, doubling, batch_size=7)
    assert {r.id: r.prediction for r in df.collect()} == {i: 2.0 * i for i in range(100)}


def test_errors_stay_with_their_rows(spark):
    df = score.score_or_error(vectors(spark, [[1.0], [-1.0], [3.0]]), "x", fussy, batch_size=3)
    rows = {r.id: (r.prediction, r.error) for r in df.collect()}
    assert rows == {0: (1.0, None), 1: (None, "Batch processing error: negative"), 2: (3.0, None)}


def test_hooks_and_retries(spark):
    def flaky():
        state = {"calls": 0}

        def predict(rows):
            state["calls"] += 1
            if state["calls"] % 2:
                raise RuntimeError("try again")
            return rows[:, 0]

        return predict

    df = score.score_or_error(
        vectors(spark, [[1.0]]), "x", flaky, max_retries=1, pre=lambda rows: rows + 1, post=lambda values: values * 10
    )
    assert [(r.prediction, r.error) for r in df.collect()] == [(20.0, None)]


def test_bad_vectors_and_predictions_are_row_errors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [3.0, 4.0])], "id int, x array<double>")

    def load():
        def predict(rows):
            if rows.shape[1:] != (2,):
                raise ValueError("two features, please")
            return rows.sum(axis=1)

        return predict

    got = {r.id: (r.prediction, r.error is None) for r in score.score_or_error(df, "x", load).collect()}
    assert got == {1: (3.0, True), 2: (None, False), 3: (None, False), 4: (7.0, True)}
    few = score.score_or_error(df.where("id = 1 OR id = 4"), "x", lambda: lambda rows: np.zeros(7)).collect()
    assert all(r.prediction is None and "predictions of shape" in r.error for r in few)


def test_versions_that_are_no_numbers(spark):
    df = spark.createDataFrame([("m", "1.0-rc1", "f1"), ("m", "1.2", "f2")], "name string, version string, file string")
    assert [r.file for r in score.latest_models(df, "file").collect()] == ["f2"]


def test_too_few_answers_are_row_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    rows = prompts.generate(df, "p", lambda: lambda texts: ["only one"]).collect()
    assert [r.response for r in rows] == ["only one"] * 2 and all(r.error is None for r in rows)
    rows = prompts.generate(df, "p", lambda: lambda texts: []).collect()
    assert all(r.response is None and "0 answers" in r.error for r in rows)


def test_response_without_provider(spark):
    row = spark.range(1).select(prompts.parse_response(F.lit(None).cast("string"), F.lit("m"), F.lit("{}")).alias("r")).first().r
    assert row.text is None and row.error == "Invalid response format from none"


def test_linear_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(20, 8)), rng.normal(size=8)
    df = vectors(spark, x.tolist()).select("id", score.linear(F.col("x"), list(w), 0.5).alias("z"))
    got = [r.z for r in df.orderBy("id").collect()]
    assert np.allclose(got, x @ w + 0.5)


def test_zscore(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0)] + [(None, float(v)) for v in (1, 2, 9)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.v): r.z for r in score.robust_zscore(df, ["k"], "v").collect()}
    assert got[(None, 9.0)] == 7.0 and got[(None, 2.0)] == 0.0
    assert got[("a", 100.0)] == 97.0 and got[("a", 3.0)] == 0.0 and got[("b", 5.0)] is None


def test_versions_are_numbers(spark):
    df = spark.createDataFrame([("m", "1.9", "f1"), ("m", "1.10", "f2"), ("n", "2", "f3")], "name string, version string, file string")
    assert {r.name: r.file for r in score.latest_models(df, "file").collect()} == {"m": "f2", "n": "f3"}


def test_models_by_name_and_version(spark):
    catalogue = spark.createDataFrame([("m", "1.9", "f1"), ("m", "1.10", "f2")], "name string, version string, file string")
    asked = spark.createDataFrame([(1, "m", None), (2, "m", "1.9"), (3, "m", "7"), (4, "x", None)], "id int, model string, wanted string")
    got = {r.id: r.file for r in score.resolve_models(asked, catalogue, "file").collect()}
    assert got == {1: "f2", 2: "f1", 3: None, 4: None}


def test_token_overlap(spark):
    df = spark.createDataFrame([("a B c", "b c d"), ("", None)], "l string, r string")
    got = [r[0] for r in df.select(score.token_overlap(F.col("l"), F.col("r"))).collect()]
    assert got == [0.5, 1.0]


def test_hidden_variables_are_summed_out(spark):
    rain = spark.createDataFrame([(1, 0.2), (0, 0.8)], "rain int, p double")
    wet = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.1), (0, 1, 0.2), (0, 0, 0.8)], "rain int, wet int, p double")
    slip = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5), (0, 1, 0.1), (0, 0, 0.9)], "wet int, slip int, p double")
    got = {(r.slip, r.rain): r.p for r in bayes.posterior([rain, wet, slip], "rain", ["slip"]).collect()}
    slipped = 0.2 * (0.9 * 0.5 + 0.1 * 0.1), 0.8 * (0.2 * 0.5 + 0.8 * 0.1)
    assert got[(1, 1)] == pytest.approx(slipped[0] / sum(slipped))
    with pytest.raises(ValueError):
        bayes.multiply(rain, slip)


def test_history_and_prompt(spark):
    turns = [(1, i, role, f"t{i}") for i, role in enumerate(["user", "assistant", "system", "tool", "user"])]
    df = spark.createDataFrame(turns, "c int, turn int, role string, text string")
    kept = prompts.history(df, ["c"], [F.col("turn")], F.floor(F.col("turn") / 2), size=4)
    row = kept.where("turn = 4").select(
        prompts.context_of(F.col("history")),
        prompts.full_prompt(F.col("history"), F.col("text")),
        prompts.full_prompt(F.col("history"), F.col("text"), dedup_prompt=True),
    ).first()
    context = "Assistant: t1\n\nSystem: t2\n\nt3"
    assert list(row) == [f"{context}\n\nUser: t4", f"{context}\n\nUser: t4\n\nUser: t4", f"{context}\n\nUser: t4"]


def test_first_prompt_alone(spark):
    df = spark.sql("SELECT array(named_struct('role', 'user', 'content', 'Test prompt')) AS h")
    assert df.select(prompts.full_prompt(F.col("h"), F.lit("Test prompt"), dedup_prompt=True)).first()[0] == "Test prompt"


def test_request_bodies(spark):
    df = spark.createDataFrame([("OpenAI",), ("anthropic",), ("LOCAL",), ("else",)], "provider string")
    options = prompts.merged_options(F.from_json(F.lit('{"max_tokens": 5}'), prompts.OPTIONS_TYPE), ModelConfig())
    body = prompts.request_body(F.col("provider"), F.lit("hi"), options)
    got = [r[0] for r in df.select(body).collect()]
    assert got[0].startswith('{"model":"gpt-4","messages":[{"role":"user","content":"hi"}]') and '"max_tokens":5' in got[0]
    assert "presence_penalty" not in got[1] and '"top_p":1.0' in got[1]
    assert got[2].startswith('{"prompt":"hi"') and "messages" not in got[2]
    assert got[3] is None
    errors = [r[0] for r in df.select(prompts.unsupported(F.col("provider"))).collect()]
    assert errors == [None, None, None, "Unsupported LLM provider: else"]


def test_further_options_are_sent(spark):
    options = prompts.merged_options(F.lit(None).cast(prompts.OPTIONS_TYPE), ModelConfig())
    extra = F.expr("map('seed', '7', 'stop', '[\"x\", \"y}\"]', 'top_p', '0.1', 'none', CAST(NULL AS STRING), 'a\"b', 'true')")
    df = spark.createDataFrame([("openai",), ("anthropic",), ("local",), ("other",)], "provider string")
    bodies = [r[0] for r in df.select(prompts.request_body(F.col("provider"), F.lit("hi"), options, extra)).collect()]
    for text in bodies[:3]:
        body = json.loads(text)
        assert body["seed"] == 7 and body["stop"] == ["x", "y}"] and body["top_p"] == 1.0 and body['a"b'] is True and "none" not in body
    assert bodies[3] is None
    empty = df.select(prompts.request_body(F.col("provider"), F.lit("hi"), options, F.lit(None).cast("map<string,string>"))).collect()
    assert empty == df.select(prompts.request_body(F.col("provider"), F.lit("hi"), options)).collect()


def test_response_bodies(spark):
    usage = '"usage":{"prompt_tokens":10,"completion_tokens":5,"total_tokens":15}'
    rows = [
        ("openai", '{"choices":[{"message":{"content":"Hello"}}],%s}' % usage),
        ("anthropic", '{"content":[{"text":"Hello"}],"usage":{"input_tokens":10,"output_tokens":5}}'),
        ("local", '{"choices":[{"text":"Hello"}]}'),
        ("openai", '{"choices":[]}'),
    ]
    df = spark.createDataFrame(rows, "p string, b string")
    got = [tuple(r[0]) for r in df.select(prompts.parse_response(F.col("p"), F.lit("m"), F.col("b"))).collect()]
    assert got == [
        ("Hello", "m", 10, 5, 15, None),
        ("Hello", "m", 10, 5, None, None),
        ("Hello", "m", None, None, None, None),
        (None, "m", None, None, None, "Invalid response format from openai"),
    ]


def test_option_maps_and_engines(spark):
    row = spark.sql("SELECT map('a', 1, 'b', 1) AS d, map('b', 2) AS o, 'x/y/z' AS e").select(
        prompts.merged_map(F.col("d"), F.col("o")), prompts.split_engine(F.col("e"))
    ).first()
    assert row[0] == {"a": 1, "b": 2} and tuple(row[1]) == ("x", "y/z")


def test_generate(spark):
    def load():
        def client(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [t.upper() for t in texts]

        return client

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d")], "id int, prompt string")
    rows = {r.id: (r.response, r.error) for r in prompts.generate(df, "prompt", load, batch_size=10).collect()}
    assert rows[1] == ("A", None) and rows[4] == ("D", None) and rows[2] == (None, "refused")
    assert rows[3] == (None, "Missing or invalid 'prompt' field in message")


def test_config_defaults():
    from eventflow.operators.review import ReviewConfig
    from eventflow.operators.route import DEFAULT_ACTION

    c = ModelConfig()
    assert (c.provider, c.model, c.temperature, c.max_tokens, c.top_p, c.timeout_secs, c.max_retries) == ("openai", "gpt-4", 0.7, 2048, 1.0, 30, 3)
    r = ReviewConfig()
    assert (r.required_approvals, r.timeout_seconds, r.default_reviewers, r.require_all_reviewers, r.allow_self_approval) == (1, 3600, (), False, False)
    assert (DEFAULT_ACTION.type, DEFAULT_ACTION.level) == ("log", "warn")


def test_timed_calls():
    seen, lock = {}, threading.Lock()

    def client(texts):
        (text,) = texts
        with lock:
            seen[text] = seen.get(text, 0) + 1
            number = seen[text]
        if text.startswith("slow") or (text.startswith("once") and number == 1):
            time.sleep(1.5)
        if text.startswith("bad"):
            raise ValueError("no")
        return [text.upper()]

    calls = prompts.TimedCalls(client, 0.5, at_once=4, most_late=3)
    texts = ["a", "slow1", "bad", "once", "b", ""]
    answers, errors = calls.ask(texts, retries=1)
    assert answers == ["A", None, None, "ONCE", "B", ""]
    assert errors == [None, "Timed out after 0.5 s", "no", None, None, None]
    assert seen == {"a": 1, "slow1": 2, "bad": 2, "once": 2, "b": 1, "": 1}
    # Late calls are bounded; once they have ended, calls go on.
    calls = prompts.TimedCalls(client, 0.3, at_once=1, most_late=1)
    answers, errors = calls.ask(["slow2", "c"])
    assert errors == ["Timed out after 0.3 s", prompts.TOO_MANY_LATE]
    time.sleep(1.6)
    assert calls.ask(["c", "d"]) == (["C", "D"], [None, None])
    assert calls.ask([]) == ([], [])


def test_generate_with_a_time_limit(spark):
    def load():
        def client(texts):
            if texts[0] == "slow":
                time.sleep(4)
            return [texts[0] * 2]

        return client

    df = spark.createDataFrame([(1, "a"), (2, "slow"), (3, None), (4, "b")], "id int, prompt string").coalesce(1)
    rows = {r.id: (r.response, r.error) for r in prompts.generate(df, "prompt", load, timeout_secs=1.5).collect()}
    assert rows == {1: ("aa", None), 2: (None, "Timed out after 1.5 s"), 3: (None, prompts.MISSING_PROMPT), 4: ("bb", None)}

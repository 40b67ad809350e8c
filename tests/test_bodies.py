"""Sniffing against the exhaustive version, and results inside request bodies."""

import json
import random

import pytest

from meterlake.operators import bodies
from meterlake.operators.bodies import rewritten, rewritten_body, tool_results
from meterlake.operators.tool_output import LEVELS, Reduced, Registry, marks, scrub
from meterlake.plans.tool_samples import SAMPLES, SNIFFED, filled

TOOLS = Registry()
GO = "\n".join([f"=== RUN   Test{i}\n--- PASS: Test{i} (0.00s)" for i in range(9)] + ["--- FAIL: TestB (0.01s)", "FAIL"])


def exhaustive(text, level):
    best, by = Reduced(scrub(text)), ""
    for name in sorted(TOOLS.reducers):
        out = TOOLS.reducers[name].reduce(text, level)
        if out.how in ("rules", "json") and out.critical_kept and out.size < best.size:
            best, by = out, name
    return best, by


def test_marks():
    assert marks(r"Get:|apt|(?:^|\n)ok  \t|a\.b\d+c") == ["get:", "apt", "ok  \t", "a.b"]
    assert marks("ab?cd|[gG]radle|x{2}|(?i)Error") == ["cd", "radle", "", "error"]


@pytest.mark.parametrize("level", LEVELS)
def test_sniffing_as_the_exhaustive_version(level):
    rng = random.Random(4)
    lines = [x for c in SAMPLES for x in filled(c, "!.-~", "brand12", 3).split("\n")]
    texts = [filled(c, "!.-~", "brand12", k) for c in SAMPLES for k in (3, 7)] + ["\n".join(rng.choices(lines, k=rng.randint(1, 8)))[rng.randint(0, 3) :] for _ in range(400)]
    for text in [*texts, "", "prose", '{"a": "aws"}', "ÉİK \x1b[1mnpm\x1b[0m"]:
        assert TOOLS.sniffed(text, level) == exhaustive(text, level)
    for c in SNIFFED:
        assert TOOLS.sniffed(filled(c, "!.-~", "brand55", 4), "balanced")[0].text == filled(c, "!.~=", "brand55", 4).strip("\n")


def test_few_candidates():
    """What a text costs doesn't grow with the tools that don't know it."""
    assert not TOOLS.sniffer.candidates("some prose that none of the tools writes")
    assert len(TOOLS.sniffer.candidates(GO)) < 5


BODY = '{ "model":"m",\t"messages":[ {"role":"user","content":"hi \\u00e9"},\n {"tool_call_id":"1","content":%s , "role":"tool"}],"n":1.50, "x":[1e3,null,{"content":"%s"}] }'


def test_only_the_string_changes():
    raw = json.dumps(GO)
    body = BODY % (raw, "=== RUN x")
    out, before, after = rewritten_body(body, TOOLS, "balanced")
    assert out == BODY % (json.dumps("--- FAIL: TestB (0.01s)\nFAIL"), "=== RUN x")
    assert (before, after) == (len(GO.encode()), len("--- FAIL: TestB (0.01s)\nFAIL"))


def test_blocks_and_parts():
    texts = [GO, GO.upper(), GO + "\nx é\U0001f600"]
    blocks = [
        {"type": "text", "text": GO},
        {"type": "tool_result", "content": texts[0]},
        {"content": [{"text": texts[1]}, {"type": "image"}, {"text": texts[2], "type": "text"}], "type": "tool_result"},
        {"type": "tool_result"},
        {"type": "tool_result", "content": 3},
    ]
    message = {"role": "user", "content": blocks}
    body = json.dumps({"messages": [message, {"role": "assistant", "content": GO}, {"role": "tool", "content": None}, "x"]})
    assert tool_results(body) == texts
    out, _, _ = rewritten_body(body, TOOLS, "balanced")
    blocks[1]["content"] = TOOLS.sniffed(texts[0], "balanced")[0].text
    blocks[2]["content"][0]["text"] = TOOLS.sniffed(texts[1], "balanced")[0].text
    blocks[2]["content"][2]["text"] = TOOLS.sniffed(texts[2], "balanced")[0].text
    assert json.loads(out)["messages"][0] == message
    assert "\U0001f600" in out


@pytest.mark.parametrize(
    "body",
    ["", "x", "[]", "3", "{}", '{"messages": 1}', '{"messages": [1, [], {"role": "tool"}]}', '{"messages": [{"role": "tool", "content": ""}]}', "[" * 5000, '{"messages": [{"role": "tool", "content": NaN}]}', '{"messages": [{"role": "tool", "content": "a\nb"}]}', '{"messages": [{"role": "user", "content": [{"type": "tool_result", "content": "a"}, 1]}]}'],
)
def test_nothing_to_do(body):
    assert tool_results(body) == [] and rewritten_body(body, TOOLS, "balanced", 0) == (body, 0, 0)


def test_the_last_of_repeated_keys_counts():
    body = '{"messages": [], "messages": [{"role": "user", "role": "tool", "content": "a", "content": "b"}]}'
    assert [(x, body[x.start : x.end]) for x in tool_results(body)] == [("b", '"b"')]


def test_half_a_surrogate_pair_stays():
    body = BODY % (json.dumps(GO)[:-1] + '\\ud800"', "")
    assert rewritten_body(body, TOOLS, "balanced") == (body, 0, 0)


def test_small_savings_stay():
    body = BODY % (json.dumps("=== RUN   TestA\n--- PASS: TestA\nFAIL"), "")
    assert rewritten_body(body, TOOLS, "balanced") == (body, 0, 0)
    assert rewritten_body(body, TOOLS, "balanced", 1)[0] == BODY % ('"FAIL"', "")


def test_columns(spark):
    body = BODY % (json.dumps(GO), "")
    rows = [(1, "openai", body), (2, "gemini", body), (3, None, body), (4, "anthropic", None), (5, "anthropic", "no json"), (6, "anthropic", body), (6, "anthropic", body), (7, "openai", "")]
    df = spark.createDataFrame(rows, "id long, provider string, body string").selectExpr("*", "9 as bytes", "'r' as r")
    got = rewritten(df).collect()
    for r in got:
        known = r.provider in bodies.PROVIDERS and r.body is not None
        want = rewritten_body(dict((x[0], x[2]) for x in rows)[r.id], TOOLS, "balanced") if known else (r.body, 0, 0)
        assert (r.body, r.bytes_before, r.bytes_after) == want and r.saved_tokens == (want[1] - want[2]) // 4 and r.bytes == 9
    assert len(got) == len(rows) and sum(r.saved_tokens > 0 for r in got) == 3
    assert rewritten(df.limit(0)).collect() == []

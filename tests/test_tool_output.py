import pytest
from pyspark.sql import functions as F

from meterlake.functions.tool_rules import TOOLS
from meterlake.operators import text, tool_output
from meterlake.operators.tool_output import LEVELS, Registry, scrub
from meterlake.plans.tool_samples import SAMPLES, expected, outputs

TOOLSET = Registry()


def test_every_tool_has_a_sample():
    assert {t.names[0] for t in TOOLS} <= {n for t in TOOLS for n in t.names if set(t.names) & SAMPLES.keys()}
    assert len(TOOLS) == 51


@pytest.mark.parametrize("command,raw", outputs())
def test_samples(command, raw):
    for level in ("balanced", "aggressive"):
        out = TOOLSET.reduce(command, raw, level)
        assert out.text == expected(command, level), level
        assert out.critical_kept
    sizes = [TOOLSET.reduce(command, raw, level).size for level in LEVELS]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] <= len(raw.encode())
    reducer = TOOLSET.reducers.get(command)
    critical = [x[1:] for x in SAMPLES[command].split("\n") if x[0] == "!"]
    for level in LEVELS:
        assert {x.strip() for x in critical} <= {x.strip() for x in TOOLSET.reduce(command, raw, level).text.split("\n")}
    assert reducer is None or all(reducer.critical(x) for x in critical)


def test_other_output_is_only_scrubbed():
    for tool in TOOLS:
        assert TOOLSET.reduce(tool.names[0], "zz\n\n\nzz \nzz\n", "aggressive").text in ("zz\n\nzz", scrub("zz\n\n\nzz \nzz\n"))


def test_a_critical_line_with_escape_codes_brings_the_whole_text_back():
    raw = "Compiling a\n\x1b[31merror: no\x1b[0m error[E1]\n"
    out = TOOLSET.reduce("cargo", raw, "balanced")
    assert (out.text, out.critical_kept, out.how) == (raw, False, "raw")


def test_json_passes():
    raw = '{\n "a": [\n  {\n  },\n  {\n  }\n ]\n}\n'
    assert TOOLSET.reduce("aws", raw, "aggressive").text == raw and TOOLSET.reduce("/usr/bin/AZ vm list", raw, "aggressive").how == "json"


def test_sniffing():
    go = "\n".join(["=== RUN TestA", "--- PASS: TestA"] * 9 + ["--- FAIL: TestB", "FAIL"])
    out, by = TOOLSET.sniffed(go, "balanced")
    assert by == "go" and out.text == "--- FAIL: TestB\nFAIL"
    assert TOOLSET.sniffed("nothing of any of them", "balanced")[1] == ""


def test_columns(spark):
    rows = [(c, t, level) for c, t in outputs() for level in LEVELS] + [("git", None, "balanced"), (None, "a \na", "balanced"), ("git", "", "balanced"), ("go", "=== RUN x\nFAIL", "odd")]
    df = spark.createDataFrame(rows, "command string, t string, level string").repartition(3)
    got = {(r.command, r.t, r.level): r.r for r in df.withColumn("r", tool_output.reduced(F.col("t"), F.col("command"), F.col("level"))).collect()}
    for (command, t, level), r in got.items():
        if t is None:
            assert r is None
        else:
            assert (r.text, r.critical_kept) == ((x := TOOLSET.reduce(command, t, level if level in LEVELS else "conservative")).text, x.critical_kept)
    assert got[(None, "a \na", "balanced")].text == "a" and got[("git", "", "balanced")].text == ""
    found = spark.createDataFrame([("=== RUN x\n--- PASS: x\nFAIL\tm\nFAIL",), (None,)], "t string").select(tool_output.sniffed(F.col("t")).alias("s")).collect()
    assert found[0].s.command == "go" and found[1].s is None


def test_plain_rules(spark):
    cases = {
        "INFO a\nERROR b\nDEBUG c\nd": ("ERROR b\nd", "ERROR b\nd"),
        "INFO ERROR x\nWARN y": ("INFO ERROR x\nWARN y", "INFO ERROR x"),
        "\x1b[1mERROR z\x1b[0m\nINFO q": ("\x1b[1mERROR z\x1b[0m\nINFO q",) * 2,
        "": ("", ""),
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    out = [F.col("t")] + [tool_output.filtered(F.col("t"), ["ERROR"], ["^INFO", "^DEBUG"], ["^WARN"], level).alias(level) for level in LEVELS]
    for r in df.select(*out).collect():
        if r.t is None:
            assert r.balanced is None
        else:
            assert (r.balanced, r.aggressive) == cases[r.t]


def test_scrub_in_both_forms(spark):
    texts = ["a\x1b[31m b \r\n\n\n  x\t\n  x\n", "", "\n\n", "a\na\n\na", "é \né"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.scrubbed(F.col("t")).alias("s"))
    assert all(r.s == scrub(r.t) for r in df.collect())

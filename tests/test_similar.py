"""The set similarity join, heads and rule compression against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import rulebook, similar
from meterlake.operators.similar import heads, prefixes, similar_pairs

DATA = "/root/testdata/sf0.001"


def brute_pairs(sets, threshold):
    out = []
    for (g, i), x in sets.items():
        for (h, j), y in sets.items():
            if g == h and i < j and x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                out.append((g, i, j))
    return sorted(out)


def brute_heads(pairs):
    member = {}
    for g, late, early in sorted((g, b, a) for g, a, b in pairs):
        if (g, late) not in member and (g, early) not in member:
            member[g, late] = early
    return sorted((*k, v) for k, v in member.items())


def corpus(seed):
    """Sets with a common part, chains of small changes, copies and sets of few tokens."""
    rng, out = random.Random(seed), {}
    for g in ("x", "y"):
        base = [f"t{rng.randint(0, 60)}" for _ in range(25)]
        for i in range(60):
            base[rng.randrange(25)] = f"t{rng.randint(0, 60)}"
            out[g, i] = frozenset(base[: rng.choice([0, 1, 2, 10, 25, 25, 25])]) | {"everywhere", "everywhere too"}
    return out | {("z", 0): frozenset(), ("z", 1): frozenset()}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
def test_pairs_and_heads(spark, threshold):
    sets = corpus(int(threshold * 100))
    df = spark.createDataFrame([(g, i, sorted(s)) for (g, i), s in sets.items()], "g string, id int, tokens array<string>")
    pairs = similar_pairs(df, threshold, ["g"])
    want = brute_pairs(sets, threshold)
    assert sorted(map(tuple, pairs.collect())) == want
    assert sorted(map(tuple, heads(pairs, ["g"]).collect())) == brute_heads(want)


def test_a_token_that_all_sets_have_is_not_joined(spark):
    rows = [(1, i, ["common", *[f"own{i}-{k}" for k in range(9)], f"pair{i // 2}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, id int, tokens array<string>")
    assert {r.token for r in prefixes(df, ["g"], 0.85).collect()} == set()
    assert {r.token for r in prefixes(df, ["g"], 0.05).collect()} >= {"pair0"}


def test_nothing(spark):
    df = spark.createDataFrame([], "g int, id int, tokens array<string>")
    assert heads(similar_pairs(df, 0.8, ["g"]), ["g"]).collect() == []


def brute_compressed(parts, similarity, across):
    """By the fold over sections in order."""
    out, group = {}, {}
    for source, nr, anchor, body in sorted(parts):
        group.setdefault("all" if across else source, []).append((source, nr, anchor, body))
    for rows in group.values():
        names = {f"{s}#{nr}": f"{s}#{a or '_preamble'}" for s, nr, a, _ in rows}
        for (s, nr, _, _), (_, body, why, of) in zip(rows, rulebook.compressed_rows([(f"{s}#{nr}", b) for s, nr, _, b in rows], similarity, 3, 24), strict=True):
            out[s, nr] = (body, why, names[of] if of else None)
    return out


BODY = "Always write the tests of a module before the module itself, and keep each of them short enough to be read at a glance by anybody who comes across it. "


def rules():
    rng = random.Random(9)
    words = BODY.split()
    parts = []
    for source in ("a", "b", "c"):
        for nr in range(14):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 99)}"
            body = rng.choice([" ".join(own), "  ".join(own) + "\n\n\n\n", "short", "", "- " + " ".join(own) + "\n- x\n- x\n", " ".join(words * 3)])
            parts.append((source, nr, "" if not nr else f"/P{nr}", body))
    return parts


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("similarity", [0.0, 0.6, 0.85])
def test_compression(spark, across, similarity):
    parts = rules()
    df = spark.createDataFrame(parts, "source_id string, nr int, anchor string, body string").selectExpr("*", "1 as id", "2 as norm", "'h' as head")
    got = {(r.source_id, r.nr): (r.body, r.reason, r.duplicate_of) for r in rulebook.compressed_corpus(df, similarity, across=across).collect()}
    assert got == brute_compressed(parts, similarity, across)


def test_a_copy_that_is_too_short_to_be_compared(spark):
    """Bodies that differ in white space only: the long ones are near-duplicates, the short one stays, and later ones repeat it."""
    short = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = short.replace(" ", "    ")
    parts = [("s", i, f"/P{i}", b) for i, b in enumerate([long + "    extra", long, long, short, long])]
    df = spark.createDataFrame(parts, "source_id string, nr int, anchor string, body string")
    got = {(r.source_id, r.nr): (r.body, r.reason, r.duplicate_of) for r in rulebook.compressed_corpus(df).collect()}
    assert got == brute_compressed(parts, 0.85, False)
    assert [got["s", i][1] for i in range(5)] == [None, "near_duplicate", "near_duplicate", None, "redundant"]


def test_the_whole_table(spark):
    from meterlake.plans.more_queries import QUERIES, _rule_sections

    parts = [(r.source_id, r.nr, r.anchor, r.body) for r in _rule_sections(spark, DATA).collect()]
    want = brute_compressed(parts, 0.85, False)
    got = {(r.source_id, r.nr): (r.digest, r.reason, r.duplicate_of) for r in QUERIES["rule_compress"](spark, DATA).collect()}
    assert got == {k: (b if b is None else hashlib.md5(b.encode()).hexdigest(), why, of) for k, (b, why, of) in want.items()}
    assert sum(v[1] == "near_duplicate" for v in got.values()) >= 0 and any(v[1] == "redundant" for v in got.values())


def test_relevance_of_many_tasks_as_of_one(spark):
    parts = [
        ("a", 0, "", "Use pytest and Make.", ".cursor/rules/go.mdc", "r1", "repo"),
        ("a", 1, "/Testing", "short", ".cursor/rules/go.mdc", "r1", "global"),
        ("b", 0, "/make", None, "docs/x.md", "r2", "global"),
        ("b", 1, None, "nothing of it", "", None, None),
        ("c", 0, "/wf-7/Deploy", "deploy with MAKE, test with pytest", "docs/x.md", "r1", "global"),
    ]
    df = spark.createDataFrame(parts, "source_id string, nr int, anchor string, body string, path string, repo string, scope string")
    asked = [
        ("t1", ["pytest", "MAKE", ""], [" test ", "deploy"], ["src/a.MD"], "r1", "WF-7"),
        ("t2", [], ["make", "make"], ["x/docs/x.md/y", ""], None, None),
        ("t3", None, None, None, "r1", ""),
        ("t4", ["absent"], ["e"], [".cursor/rules/go.mdc"], "r2", "deploy"),
        (None, ["make"], ["e"], [], "r1", "x"),
    ]
    tasks = spark.createDataFrame(asked, "task string, tools array<string>, keywords array<string>, paths array<string>, repo string, workflow string")
    for globally in (False, True):
        got = {(r.task, r.source_id, r.nr): r.score for r in rulebook.task_relevance(df, tasks, globally).collect()}
        want = {}
        for task, tools, keywords, paths, repo, workflow in asked[:4]:
            one = rulebook.relevance(df.fillna("", ["anchor", "body", "path"]), tools or [], keywords or [], paths or [], repo or "", workflow or "", globally)
            bare = rulebook.relevance(df.fillna("", ["anchor", "body", "path"]), tools or [], keywords or [], paths or [], "", workflow or "", False)
            linked = {(r.source_id, r.nr) for r in bare.filter("score > 0").collect()}
            want |= {(task, r.source_id, r.nr): r.score for r in one.collect() if (r.source_id, r.nr) in linked}
        assert got == want


def test_terms_in_several_lots(spark, monkeypatch):
    parts = spark.createDataFrame([("s", i, "/x", f"alpha{i} beta{i}") for i in range(12)], "source_id string, nr int, anchor string, body string")
    tasks = spark.createDataFrame([(i, [f"alpha{i}"], [f"beta{i}"]) for i in range(12)], "task int, tools array<string>, keywords array<string>")
    want = sorted(map(tuple, rulebook.task_relevance(parts, tasks).collect()))
    monkeypatch.setattr(rulebook, "TERMS", 5)
    assert sorted(map(tuple, rulebook.task_relevance(parts, tasks).collect())) == want
    assert (3, "s", 3, 1.5) in want and (1, "s", 11, 1.5) in want and len(want) == 12 + 2
    assert rulebook.task_relevance(parts, tasks.limit(0)).collect() == [] and rulebook.task_relevance(parts.limit(0), tasks).collect() == []


def plain_compressed(parts, similarity, n, least_tokens):
    """Each section against all that stay before it."""
    import re

    kept, seen, out = [], {}, []
    for sid, body in parts:
        key = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", body.strip()))
        words = [w for w in re.split(r"[ \t\n\r,.;:!?()\"']+", re.sub(r"(?m)^[ \t\n\r\f\v]*[-*+][ \t\n\r\f\v]+", "", body)) if w]
        own = {" ".join(words[i : i + n]).lower() for i in range(len(words) - n + 1)} if similarity and len(body.encode()) > 4 * (least_tokens - 1) else set()
        near = next((k for k, x in kept if own and len(own & x) >= similarity * len(own | x) - 1e-9), None)
        if key in seen:
            out.append((sid, None, "redundant", seen[key]))
        elif near is not None:
            out.append((sid, None, "near_duplicate", near))
        else:
            seen[key] = sid
            kept += [(sid, own)] if own else []
            out.append((sid, rulebook.compacted(body), None, None))
    return out


def rule_texts():
    """Documents with many headings over near copies, with blanks and line ends that Java and Python take differently."""
    rng, out = random.Random(4), []
    for _ in range(12):
        words, parts = BODY.split(), []
        for _ in range(rng.choice([0, 1, 12, 40])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 9])):
                own[rng.randrange(len(own))] = f"W{rng.randint(0, 9)}"
            body = rng.choice([" ".join(own), "\xa0" + "  ".join(own) + "\u3000\n\n\n\n", "short", "", "- a\x85- " + " ".join(own) + "\u2028* x\n-\xa0y\n", "\x1c" + " ".join(own).upper()])
            parts.append(f"{'#' * rng.randint(1, 3)} P{rng.randint(0, 3)}\n{body}\n")
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("similarity", [0.0, 0.3, 0.85, 1.0])
def test_sections_of_a_document_against_a_plain_loop(similarity):
    seen = set()
    for text in rule_texts():
        parts = [(str(i), b) for i, (_, _, b) in enumerate(rulebook.sections_of(text))]
        got = rulebook.compressed_rows(parts, similarity, 3, 24)
        assert got == plain_compressed(parts, similarity, 3, 24)
        seen |= {r[2] for r in got}
    assert seen == {None, "redundant"} | ({"near_duplicate"} if 0 < similarity < 1 else set())


def test_large_documents_come_out_as_others_do(spark, monkeypatch):
    texts = [*enumerate(rule_texts()), (97, None), (None, "# A\nx\n"), (98, "")]
    df = spark.createDataFrame(texts, "source_id long, text string")
    found = []
    for most in (1 << 30, 2_000, -1):
        monkeypatch.setattr(rulebook, "LARGE", most, raising=False)
        out = rulebook.compressed(df)
        found.append(sorted(map(tuple, out.select("source_id", "nr", "anchor", "body", "reason", "duplicate_of", "original_tokens", "compressed_tokens", "accepted").collect()), key=lambda r: r[:2]))
    assert found[0] == found[1] == found[2] and len({r[0] for r in found[0]}) == len(texts) - 1
    assert {r[4] for r in found[0]} == {None, "redundant", "near_duplicate"}


def test_nothing_of_a_document_is_shuffled_or_written_on_the_way(spark, monkeypatch):
    """All sections and all their shingles were, several times: some 30 times the input of disk."""
    from meterlake.plans.more_queries import QUERIES

    for module in (rulebook, similar):
        monkeypatch.setattr(module, "written", lambda *_: pytest.fail("a table on the way"))
    out = QUERIES["rule_compress"](spark, DATA)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInPandas") == 1


def test_near_copies_of_one_document_are_not_all_compared(monkeypatch):
    """Sections with a common part and much of their own: each was compared with all before it."""
    met = []

    class Counted(frozenset):
        def __and__(self, other):
            met.append(1)
            return frozenset.__and__(self, other)

    monkeypatch.setattr(rulebook, "_shingles", lambda body, n, of=rulebook._shingles: Counted(of(body, n)))
    parts = [(str(i), "the common part of all " + " ".join(f"own{i}x{k}" for k in range(30))) for i in range(200)]
    assert all(r[2] is None for r in rulebook.compressed_rows(parts, 0.85, 3, 24)) and len(met) < 200

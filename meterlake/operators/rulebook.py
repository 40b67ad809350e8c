"""Rule documents: sections, duplicates, compression, conflicts, return on their tokens, selection for a task."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.tables import BATCH_BYTES, bounded_batches, written
from .similar import SLACK, heads, similar_pairs

# Pairs of word lists that contradict each other, by name.
CONTRARY = [
    ("concise_vs_verbose", ["be concise", "keep it short", "be brief", "terse"], ["explain thoroughly", "be detailed", "verbose", "comprehensive explanation"]),
    ("tdd_vs_test_after", ["write tests first", "tdd", "red-green-refactor", "test before"], ["write tests after", "tests after implementation", "skip tests"]),
    ("comments_required_vs_no_comments", ["always comment", "document every function", "comment all"], ["no comments", "avoid comments", "comments are noise"]),
    ("ask_before_acting_vs_autonomous", ["ask before acting", "confirm with user", "wait for approval"], ["act autonomously", "do not ask", "skip confirmation"]),
]


def source_kind(path: Column) -> Column:
    """Which kind of rule document a path is."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    kind = F.when(base == "claude.md", "claude_md").when(base == "agents.md", "agents_md")
    kind = kind.when(F.lower(path).rlike(r"(^|/)\.cursor/rules/"), "cursor_rules")
    return kind.when(base.rlike(r"\.mcp\.(yaml|yml|json)$") | (base == "mcp.policy.yaml"), "mcp_policy").otherwise("repo_convention")


def default_scope(kind: Column) -> Column:
    return F.when(kind == "cursor_rules", "file_glob").when(kind == "mcp_policy", "tool").otherwise("repo")


def source_id(repo: Column, path: Column) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.coalesce(repo, F.lit("")) == "", clean).otherwise(F.concat(repo, F.lit(":"), clean))


def sections_of(text: str) -> list[tuple[str, int, str]]:
    """(anchor, level, body) of each part of a Markdown text: what comes before the first heading, then each heading's; headings in fences don't count."""
    out, path, body, fence, level = [], [], [], None, 0
    lines = text.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        line = line.removesuffix("\r")
        bare = line.lstrip(" \t")
        mark = bare[:3]
        if mark in ("```", "~~~"):
            fence = mark if fence is None else None if mark == fence else fence
        elif fence is None and (m := re.match(r"(#{1,6})[ \t](.*)", bare, re.DOTALL)):
            out.append(("/".join(path), level, "".join(body)))
            body, level = [], len(m[1])
            path = [*path[: level - 1], *[""] * (level - 1 - len(path)), m[2].strip()]
            continue
        body.append(line + "\n")
    return [*out, ("/".join(path), level, "".join(body))]


#: what a row takes in Python beside its texts
_ROW_BYTES = 400


def _frames(rows: Iterator[tuple], columns: list[str], most: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """Rows as frames of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += _ROW_BYTES + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def sections(docs: DataFrame, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """(source_id, nr, anchor, level, body, hash) of each document; the order of lines decides, so this is an Arrow UDF. A null text counts as empty.

    A Python worker holds about BATCH_BYTES of texts and as much of sections, or one document's.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(((i, n, *s) for batch in batches for i, t in zip(batch["source_id"], batch["text"], strict=True) for n, s in enumerate(sections_of(t))), ["source_id", "nr", "anchor", "level", "body"])

    cut = docs.select(F.col(id_col).cast("string").alias("source_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return cut.mapInPandas(run, "source_id string, nr int, anchor string, level int, body string").withColumn("hash", F.concat(F.lit("sha256:"), F.sha2(F.col("body").cast("binary"), 256)))


def section_id(source: str = "source_id", anchor: str = "anchor") -> Column:
    """What stands before the first heading is the preamble."""
    return F.concat(F.col(source), F.lit("#"), F.when(F.col(anchor) == "", "_preamble").otherwise(F.col(anchor)))


def document_summary(parts: DataFrame, top: int = 5, bytes_per_token: float = 4.0) -> DataFrame:
    """A row for each document: sections, bytes, tokens and the anchors of its `top` largest sections (ties: the earlier one)."""
    size = F.octet_length("body")
    tokens = F.ceil(size / F.lit(bytes_per_token)).cast("long")
    ranked = parts.withColumns({"bytes": size.cast("long"), "tokens": tokens}).withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("tokens"), "nr")))
    largest = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "anchor")))), lambda x: x["anchor"])
    per_k = F.round(F.coalesce(F.sum("tokens") * 1000.0 / F.nullif(F.sum("bytes"), F.lit(0)), F.lit(0.0)), 6)
    return ranked.groupBy("source_id").agg(F.count("*").alias("sections"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), per_k.alias("tokens_per_k"), F.array_join(largest, "|").alias("largest"))


#: sections of a key from which on it is broadcast: there are at most as many such keys as sections by this
HOT = 10_000


def _joined(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows with the columns of their key, both written tables; keys have its number of rows as `sections`.

    A key may have a large share of the rows: they meet broadcast keys where they are, and only the others' are shuffled.
    """
    hot = F.broadcast(keys.filter(F.col("sections") > HOT))
    rest = rows.join(hot.select(on), on, "left_anti").join(keys.filter(F.col("sections") <= HOT), on)
    return rows.join(hot, on).unionByName(rest)


def redundant(parts: DataFrame) -> DataFrame:
    """(hash, sections, id): a row for each section whose body two sections or more have, blank ones aside."""
    named = written(parts.filter(F.btrim("body", F.lit(" \t\r\n")) != "").select("hash", section_id().alias("id")), "bodies")
    shared = written(named.groupBy("hash").agg(F.count("*").alias("sections")).filter("sections >= 2"), "shared")
    return _joined(named, shared, "hash").select("hash", "sections", "id")


def drifting(parts: DataFrame) -> DataFrame:
    """(anchor, sections, bodies, id, hash): a row for each section under a heading that stands, whatever its case, over different bodies."""
    named = written(parts.filter("anchor <> ''").select(F.lower("anchor").alias("anchor"), "hash", section_id().alias("id")), "headings")
    bodies = named.groupBy("anchor", "hash").agg(F.count("*").alias("n")).groupBy("anchor").agg(F.sum("n").alias("sections"), F.count("*").alias("bodies"))
    return _joined(named, written(bodies.filter("sections >= 2 and bodies >= 2"), "drift"), "anchor").select("anchor", "sections", "bodies", "id", "hash")


def contrary(parts: DataFrame, patterns: list[tuple[str, list[str], list[str]]] | None = None) -> DataFrame:
    """(pattern, inside, id, side): a row for each section that trips both sides of a pattern (inside, no side), and for each
    that trips one (side a or b) where some section trips the other only."""
    low = F.lower("body")

    def trips(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    hits = F.array(*[F.struct(F.lit(n).alias("pattern"), trips(a).alias("a"), trips(b).alias("b")) for n, a, b in patterns or CONTRARY])
    rows = parts.select(section_id().alias("id"), F.explode(hits).alias("h")).select("id", "h.*").filter("a or b").groupBy("id", "pattern").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    alone = rows.filter("a <> b")
    # a row for each pattern, of which there are as many as were asked for
    met = alone.groupBy("pattern").agg(F.max("a").alias("some_a"), F.max("b").alias("some_b")).filter("some_a and some_b").select("pattern")
    both = rows.filter("a and b").select("pattern", F.lit(True).alias("inside"), "id", F.lit(None).cast("string").alias("side"))
    across = alone.join(F.broadcast(met), "pattern").select("pattern", F.lit(False).alias("inside"), "id", F.when(F.col("a"), "a").otherwise("b").alias("side"))
    return both.unionByName(across)


_SPACES, _BLANKS, _BULLETS = re.compile(r"[ \t]+"), re.compile(r"\n{3,}"), re.compile(r"(?m)^\s*[-*+]\s+", re.ASCII)
_WORD_PARTS = re.compile(r"[ \t\n\r,.;:!?()\"']+")


def compacted(body: str) -> str:
    """Single spaces, single blank lines, and no line that repeats the one before it, blank ones between aside."""
    out: list[str] = []
    last = ""
    for line in _BLANKS.sub("\n\n", _SPACES.sub(" ", body)).split("\n"):
        t = line.strip()
        if t and t != last:
            out.append(t)
            last = t
        elif not t and out and out[-1]:
            out.append("")
    return "\n".join(out).strip()


def _shingles(body: str, n: int) -> frozenset[str]:
    words = [w.lower() for w in _WORD_PARTS.split(_BULLETS.sub("", body)) if w]
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))


def _shared_first(sets: list[frozenset[str]], similarity: float) -> list[list[str]]:
    """Of each set its rarest shingles, of which every similar set has one among its own, those that no other set has left out."""
    counts = Counter(chain.from_iterable(sets))
    if len(counts) == sum(map(len, sets)):
        return [[]] * len(sets)
    return [[x for x in sorted(s, key=lambda x: (counts[x], x))[: len(s) - math.ceil(len(s) * similarity - SLACK) + 1] if counts[x] > 1] if any(counts[x] > 1 for x in s) else [] for s in sets]


def compressed_rows(parts: list[tuple[str, str]], similarity: float, n: int, least_tokens: int) -> list[tuple]:
    """(id, body or None, reason or None, id it repeats or None) of a document's (id, body) sections in order."""
    sets = [_shingles(body, n) if similarity > 0 and -(-len(body.encode()) // 4) >= least_tokens else frozenset() for _, body in parts]
    kept, seen, out = {}, {}, []
    for nr, ((sid, body), own, first) in enumerate(zip(parts, sets, _shared_first(sets, similarity), strict=True)):
        key = hashlib.sha256(_BLANKS.sub("\n\n", _SPACES.sub(" ", body.strip())).encode()).digest()
        if key in seen:
            out.append((sid, None, "redundant", seen[key]))
            continue
        met = sorted({k for x in first for k in kept.get(x, ())})
        near = next((k for k in met if len(own & sets[k]) >= similarity * len(own | sets[k]) - SLACK), None)
        if near is not None:
            out.append((sid, None, "near_duplicate", parts[near][0]))
            continue
        seen[key] = sid
        for x in first:
            kept.setdefault(x, []).append(nr)
        out.append((sid, compacted(body), None, None))
    return out


#: bytes of a document from which on it isn't one unit of work
LARGE = 1 << 20


def compressed(docs: DataFrame, similarity: float = 0.85, n: int = 3, least_tokens: int = 24, floor: float = 0.6, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """(source_id, nr, anchor, body, reason, duplicate_of, original_tokens, compressed_tokens, accepted): each section kept in compact form or dropped.

    The earlier section of a document is the one that stays. accepted: of the document, whether
    what is left is at least `floor` of its tokens. A document of up to LARGE bytes is one unit of
    work where it is read, so nothing of it is shuffled or written; larger ones go through
    `compressed_corpus`. Rows with a null id take no part.
    """
    schema = "source_id string, nr int, anchor string, body string, reason string, duplicate_of string, original_tokens long, compressed_tokens long, accepted boolean"
    tokens = lambda t: -(-len(t.encode()) // 4)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for source, text in zip(batch["source_id"], batch["text"], strict=True):
                    parts = sections_of(text)
                    found = compressed_rows([(f"{source}#{a or '_preamble'}", b) for a, _, b in parts], similarity, n, least_tokens)
                    before, after = sum(tokens(b) for _, _, b in parts), sum(tokens(b) for _, b, _, _ in found if b is not None)
                    yield from ((source, i, parts[i][0], b, why, of, tokens(parts[i][2]), tokens(b or ""), not before or after >= floor * before) for i, (_, b, why, of) in enumerate(found))

        yield from _frames(rows(), [c.strip().split(" ")[0] for c in schema.split(",")])

    cut = docs.select(F.col(id_col).cast("string").alias("source_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("source_id is not null")
    large = cut.filter(F.octet_length("text") > LARGE)
    out = cut.filter(F.octet_length("text") <= LARGE).mapInPandas(run, schema)
    return out if large.isEmpty() else out.unionByName(compressed_corpus(sections(large), similarity, n, least_tokens, floor))


#: what Python's strip takes off
_BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def gram_set(body: Column, n: int) -> Column:
    """The distinct n-grams of a body's words in lower case, list marks left out."""
    plain = F.regexp_replace(body, r"(?md)^\s*[-*+]\s+", "")
    words = F.filter(F.split(plain, "[ \t\n\r,.;:!?()\"']+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        count = F.size(w) - n + 1
        return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.lower(F.array_join(F.slice(w, i + 1, n), " "))))).otherwise(F.array().cast("array<string>"))

    return let(words, grams)


def compressed_corpus(parts: DataFrame, similarity: float = 0.85, n: int = 3, least_tokens: int = 24, floor: float = 0.6, across: bool = False) -> DataFrame:
    """As `compressed`, of parts (source_id, nr, anchor, body), without taking a document as one unit of work.

    Near-duplicates come from a set similarity join, so a document, or with `across` all documents
    in order of source_id, may have any number of sections. A section that repeats the body of an
    earlier one goes to the first of them that stays.
    """
    bounded_batches(parts.sparkSession)
    by = [] if across else ["source_id"]
    tokens = F.ceil(F.octet_length("body") / 4).cast("long")
    trimmed = F.regexp_replace("body", rf"\A[{_BLANK}]+|[{_BLANK}]+\z", "")
    norm = F.sha2(F.regexp_replace(F.regexp_replace(trimmed, "[ \t]+", " "), "\n{3,}", "\n\n").cast("binary"), 256)
    grams = F.when((F.lit(similarity) > 0) & (tokens >= least_tokens), gram_set(F.col("body"), n)).otherwise(F.array().cast("array<string>"))
    rows = parts.filter("source_id is not null").select("source_id", "nr", "anchor", "body", tokens.alias("tokens"), norm.alias("norm"), grams.alias("grams"), F.struct("source_id", "nr").alias("id"))
    rows = written(rows, "sections")
    compared = F.size("grams") > 0
    # of the sections with one body: the first, and the first that is too short to be compared
    same = rows.groupBy(*by, "norm").agg(F.min(F.struct("id", compared.alias("compared"))).alias("f"), F.min(F.when(~compared, F.col("id"))).alias("free")).select(*by, "norm", F.col("f.id").alias("first"), F.col("f.compared").alias("compared"), "free")
    same = written(same, "bodies")
    firsts = rows.join(same.filter("compared").select(*by, F.col("first").alias("id")), [*by, "id"], "left_semi")
    group = [*by] or ["everything"]
    sets = firsts.select(*by, *([] if by else [F.lit(1).alias("everything")]), "id", F.col("grams").alias("tokens"))
    found = heads(similar_pairs(sets, similarity, group), group).select(*by, F.col("id").alias("first"), F.col("head"))
    owned = rows.join(same.join(found, [*by, "first"], "left"), [*by, "norm"])
    stays = F.when(F.col("head").isNull(), F.col("id") == F.col("first")).otherwise(F.coalesce(F.col("id") == F.col("free"), F.lit(False)))
    near = F.col("head").isNotNull() & (F.col("free").isNull() | (F.col("id") < F.col("free")))
    owner = F.when(near, F.col("head")).when(F.col("head").isNotNull(), F.col("free")).otherwise(F.col("first"))
    owned = owned.withColumns({"stays": stays, "reason": F.when(~stays, F.when(near, "near_duplicate").otherwise("redundant")), "owner": F.when(~stays, owner).otherwise(F.col("id"))})  # one that stays meets itself: nulls would all meet in one task

    @F.pandas_udf("string")
    def compact(bodies: pd.Series) -> pd.Series:
        return bodies.map(compacted)

    names = rows.select(F.col("id").alias("owner"), section_id().alias("duplicate_of"))
    out = owned.join(names, "owner").withColumns({"body": F.when(F.col("stays"), compact(F.col("body"))), "duplicate_of": F.when(~F.col("stays"), F.col("duplicate_of"))})
    out = out.withColumns({"original_tokens": F.col("tokens"), "compressed_tokens": F.coalesce(F.ceil(F.octet_length("body") / 4).cast("long"), F.lit(0).cast("long"))})
    out = written(out.select("source_id", "nr", "anchor", "body", "reason", "duplicate_of", "original_tokens", "compressed_tokens"), "compressed")
    sums = out.groupBy("source_id").agg(F.sum("original_tokens").alias("o"), F.sum("compressed_tokens").alias("c"))
    return out.join(sums.select("source_id", ((F.col("o") == 0) | (F.col("c") >= F.col("o") * F.lit(floor))).alias("accepted")), "source_id")


def returns(exposures: DataFrame, retry_rate: float = 0.10, per_retry: int = 800, growth: float = 1.08) -> DataFrame:
    """Each exposure (requests, rule_tokens, output_tokens, baseline_tokens, retries, …) with context_tokens, tokens_saved, retries_avoided, context_reduction and roi.

    Without a baseline one is assumed, `growth` times the output. No cost: roi 0.
    """
    requests, output = F.col("requests"), F.col("output_tokens")
    base = F.when(F.coalesce("baseline_tokens", F.lit(0)) == 0, (output * F.lit(growth)).cast("long")).otherwise(F.col("baseline_tokens"))
    avoided = F.greatest((requests * F.lit(retry_rate)).cast("long") - F.col("retries"), F.lit(0))
    out = exposures.withColumns({"baseline": base, "retries_avoided": avoided, "context_tokens": F.col("rule_tokens") * F.greatest(requests, F.lit(0))})
    out = out.withColumn("tokens_saved", F.greatest(F.col("baseline") - output, F.lit(0)) + F.col("retries_avoided") * per_retry)
    reduction = F.when(F.col("baseline") > 0, F.round((F.col("baseline") - output) / F.col("baseline"), 6)).otherwise(0.0)
    roi = F.when(F.col("context_tokens") > 0, F.round((F.col("tokens_saved") - F.col("context_tokens")) / F.col("context_tokens"), 6)).otherwise(0.0)
    return out.withColumns({"context_reduction": reduction, "roi": roi}).drop("baseline")


def winners(scores: DataFrame) -> DataFrame:
    """(scenario, profile): the profile of the highest roi of each scenario; ties by name."""
    w = Window.partitionBy("scenario").orderBy(F.desc("roi"), "profile")
    return scores.withColumn("nr", F.row_number().over(w)).filter("nr = 1").select("scenario", "profile")


def relevance(parts: DataFrame, tools: list[str] = (), keywords: list[str] = (), paths: list[str] = (), repo: str = "", workflow: str = "", global_scope: bool = False) -> DataFrame:
    """parts with score: points for scope, repository, path, tools and keywords. parts may have columns path, repo and scope."""
    body, anchor = F.lower("body"), F.lower("anchor")
    points = lambda on, n: F.when(on, n).otherwise(0.0)
    has = set(parts.columns)
    score = F.lit(0.0)
    if global_scope and "scope" in has:
        score += points(F.col("scope") == "global", 1.0)
    if repo and "repo" in has:
        score += points(F.col("repo") == repo, 0.5)
    if paths and "path" in has:
        ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
        near = F.lit(False)
        for p in filter(None, paths):
            near = near | (F.lit(p) == F.col("path")) | ((F.length(ext) > 1) & F.lit(p.lower()).endswith(ext)) | F.lit(p).contains(F.col("path"))
        score += points((F.coalesce("path", F.lit("")) != "") & near, 1.0)
    for t in filter(None, map(str.lower, tools)):
        score += points(body.contains(t) | anchor.contains(t), 1.0)
    for k in filter(None, (k.strip().lower() for k in keywords)):
        score += points(anchor.contains(k), 1.0) + points(body.contains(k), 0.5)
    if workflow:
        score += points(anchor.contains(workflow.lower()), 0.5)
    return parts.withColumn("score", score)


#: distinct terms that one automaton holds; more are looked for in several passes
TERMS = 200_000


def _found_terms(parts: DataFrame, terms: DataFrame) -> DataFrame:
    """An inverted index (term, source_id, nr, in_anchor, in_body) of the terms that a section has anywhere in its text, in one pass over it."""
    spark, lots = parts.sparkSession, max(1, -(-terms.count() // TERMS))
    bounded_batches(spark)
    text = parts.select("source_id", "nr", F.lower(F.coalesce("anchor", F.lit(""))).alias("anchor"), F.lower(F.coalesce("body", F.lit(""))).alias("body"))
    out = None
    for lot in range(lots):
        own = [r.term for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(lots)) == lot).collect()]  # TERMS at most, about
        sent = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term in sent.value:
                automaton.add_word(term, term)
            if sent.value:
                automaton.make_automaton()
            within = lambda t: {x for _, x in automaton.iter(t)} if sent.value else set()

            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for source, nr, anchor, body in zip(batch["source_id"], batch["nr"], batch["anchor"], batch["body"], strict=True):
                        a, b = within(anchor), within(body)
                        yield from ((t, source, nr, t in a, t in b) for t in a | b)

            yield from _frames(rows(), ["term", "source_id", "nr", "in_anchor", "in_body"])

        found = text.mapInPandas(run, "term string, source_id string, nr int, in_anchor boolean, in_body boolean")
        out = found if out is None else out.unionByName(found)
    return out


def _near_paths(parts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, path): rule paths that a file of the task equals, contains, or has the extension of; by equality joins on the parts of file names."""
    rules = parts.select("path").filter("path <> ''").distinct().withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    files = tasks.select("task", F.explode("paths").alias("file")).filter("file <> ''").distinct()
    ends = files.select("task", F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).alias("ext")).filter("ext <> ''").distinct()
    size = F.length("file")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.substr("file", i, k))))
    inside = files.select("task", F.explode(F.array_distinct(pieces)).alias("path")).join(rules.select("path"), "path")
    return inside.select("task", "path").unionByName(ends.join(rules.filter("ext <> ''"), "ext").select("task", "path")).distinct()


def task_relevance(parts: DataFrame, tasks: DataFrame, global_scope: bool = False) -> DataFrame:
    """(task, source_id, nr, score) of the sections that a task has some tool, keyword, workflow or path in common with.

    tasks: task and any of tools, keywords, paths (arrays), repo, workflow; parts may have path, repo and
    scope. Points as in `relevance`, for all tasks at once: terms are found by an inverted index, so
    no task is compared with sections that have nothing of it. A repository alone is no link, nor is
    the global scope; both only add to one. Ids (source_id, nr) and tasks are unique; null ones take no part.
    """
    none = {"tools": "array<string>", "keywords": "array<string>", "paths": "array<string>", "repo": "string", "workflow": "string"}
    tasks = tasks.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in tasks.columns}).filter("task is not null")
    parts = parts.withColumns({c: F.lit(None).cast("string") for c in ("path", "repo", "scope") if c not in parts.columns})
    # a tool counts each time it is named, as does a keyword
    named = lambda kind, c: tasks.select("task", F.lit(kind).alias("kind"), F.explode(c).alias("term"))
    asked = named("tool", F.transform("tools", F.lower)).unionByName(named("keyword", F.transform("keywords", lambda k: F.lower(F.btrim(k))))).unionByName(named("workflow", F.array(F.lower("workflow"))))
    asked = written(asked.filter("term <> ''"), "terms")
    index = _found_terms(parts, asked.select("term").distinct())
    a, b = F.col("in_anchor"), F.col("in_body")
    points = F.when(F.col("kind") == "tool", 1.0).when(F.col("kind") == "workflow", F.when(a, 0.5).otherwise(0.0)).otherwise(F.when(a, 1.0).otherwise(0.0) + F.when(b, 0.5).otherwise(0.0))
    hits = index.join(asked, "term").select("task", "source_id", "nr", points.alias("score")).filter("score > 0")
    paths = parts.select("source_id", "nr", "path").join(_near_paths(parts, tasks), "path").select("task", "source_id", "nr", F.lit(1.0).alias("score"))
    sums = hits.unionByName(paths).groupBy("task", "source_id", "nr").agg(F.sum("score").alias("score"))
    facts = parts.select("source_id", "nr", F.col("repo").alias("r"), "scope")
    out = sums.join(facts, ["source_id", "nr"]).join(tasks.select("task", "repo"), "task")
    more = F.when((F.col("repo") != "") & (F.col("repo") == F.col("r")), 0.5).otherwise(0.0) + F.when(F.lit(global_scope) & (F.col("scope") == "global"), 1.0).otherwise(0.0)
    return out.select("task", "source_id", "nr", (F.col("score") + more).alias("score"))


def selected(scored: DataFrame, budget: int, least: float = 1.0, key: str | None = None) -> DataFrame:
    """Sections of a score of `least` or more, best first, as long as they fit: one that doesn't is passed over, smaller ones after it may fit.

    scored: id, tokens, score (and key: a selection for each of its values). Ties by id. The
    order decides, so each selection is a fold over its candidates; candidates are few next to
    the corpus, as only relevant sections are.
    """
    scored = scored.filter(F.col("score") >= least)
    group = F.col(key) if key else F.lit(1)
    item = F.struct((-F.col("score")).alias("rank"), "id", "tokens")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:string,tokens:bigint,score:double>>").alias("chosen"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        more = F.array(F.struct(x["id"].cast("string").alias("id"), x["tokens"].cast("long").alias("tokens"), (-x["rank"]).cast("double").alias("score")))
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, F.concat(acc["chosen"], more)).otherwise(acc["chosen"]).alias("chosen"))

    folded = scored.groupBy(group.alias("selection")).agg(F.array_sort(F.collect_list(item)).alias("items")).select("selection", F.aggregate("items", start, step).alias("a"))
    out = folded.select("selection", F.posexplode("a.chosen").alias("place", "c")).select("selection", "place", "c.*")
    return out.withColumnRenamed("selection", key) if key else out.drop("selection")

"""What prompts, replies, tool calls and session logs say about how a tool is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

# Short prompts that only confirm, and those that leave the scope open.
ACKS = ["yes", "no", "ok", "okay", "continue", "go", "proceed", "sure", "yes please", "do it", "go ahead", "keep going"]
VAGUE = ["fix all", "fix it all", "fix it", "do it", "go", "merge it", "ship it", "commit it", "commit and push", "make it work"]
# Fixed value: prompts that ask for another try.
REGENERATE = r"(?i)\b(try again|do it again|do it differently|redo|nope|that('| i)s wrong|wrong|incorrect|not (what i wanted|right))\b"
# Parts of a text that point to a file.
FILE_MARKS = [".go", ".ts", ".tsx", ".js", ".py", ".rs", ".md", ".yaml", ".yml", ".json", ".sql", ".sh", ".html", ".css", "pkg/", "internal/", "src/", "cmd/"]
# Word classes of replies.
ARTICLES = ["a", "an", "the"]
FILLERS = ["just", "really", "basically", "actually", "simply", "very", "quite", "rather", "sure", "certainly", "absolutely", "definitely", "happy", "glad", "pleased", "perhaps", "maybe", "possibly", "essentially", "fundamentally"]
WORD = "[A-Za-z][A-Za-z'-]*"
# Fixed value: commands that can't be taken back.
DESTRUCTIVE = r"(?i)\b(rm\s+-rf?|sudo\s+rm|git\s+push\s+--force|git\s+push\s+-f\b|--no-verify|drop\s+table|truncate\s+table|delete\s+from|chmod\s+777|killall\s+|shutdown\s|reboot)\b"
#: Seconds that a turn is taken to last.
SECONDS_A_TURN = 30.0


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def prompt_facts(prompts: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, low, bytes, words) of each prompt that isn't null."""
    t = prompts.filter(F.col(text_col).isNotNull()).select(trimmed(F.col(text_col)).alias("text"))
    words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", r"\s+")))
    return t.select("text", F.lower("text").alias("low"), F.octet_length("text").alias("bytes"), words.alias("words"))


def prompt_findings(prompts: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: counts by length in words, and of the habits that cost turns; averages are null without prompts."""
    f = prompt_facts(prompts, text_col)
    b, w = F.col("bytes"), F.col("words")
    points = F.lit(False)
    for mark in FILE_MARKS:
        points = points | F.col("text").contains(mark)
    return f.agg(
        F.count("*").alias("prompts"),
        F.count_if(w < 5).alias("under_5_words"),
        F.count_if((w >= 5) & (w < 15)).alias("under_15_words"),
        F.count_if((w >= 15) & (w < 50)).alias("under_50_words"),
        F.count_if((w >= 50) & (w < 200)).alias("under_200_words"),
        F.count_if(w >= 200).alias("longer"),
        F.count_if(F.col("low").isin(ACKS)).alias("acks"),
        F.count_if(F.col("low").isin(VAGUE)).alias("vague"),
        F.count_if((b < 15) & (w <= 3)).alias("vague_short"),
        F.count_if((b < 60) & F.col("text").contains("?")).alias("short_questions"),
        F.count_if(F.col("text").rlike(REGENERATE)).alias("regenerates"),
        F.count_if((b > 5) & (b < 30) & ~F.col("text").rlike("[.,:;()]")).alias("no_context"),
        F.count_if((w >= 3) & (w <= 20) & ~points).alias("no_file"),
        F.min("bytes").alias("min_bytes"),
        F.max("bytes").alias("max_bytes"),
        F.round(F.avg("bytes"), 6).alias("mean_bytes"),
        F.round(F.avg("words"), 6).alias("mean_words"),
    )


def repeated_prompts(prompts: DataFrame, text_col: str = "text", least: int = 3, top: int = 10) -> DataFrame:
    """The `top` prompts of more than 5 bytes that come `least` times or more, whatever their case; ties by text."""
    f = prompt_facts(prompts, text_col).filter("bytes > 5")
    return f.groupBy(F.col("low").alias("text")).agg(F.count("*").alias("times")).filter(F.col("times") >= least).orderBy(F.desc("times"), "text").limit(top)


def recommendations(findings: DataFrame, repeats: DataFrame) -> DataFrame:
    """(id, frequency, impact, turns_saved), by impact: what the findings suggest; `healthy` if nothing, `no_data` without prompts."""
    wasted = repeats.agg(F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("wasted"), F.lit(1).alias("only"))
    f = findings.withColumn("only", F.lit(1)).join(wasted, "only")  # one row and one row
    n = F.col("prompts").cast("double")
    extra = F.greatest(F.col("acks") - F.floor(F.lit(0.10) * n).cast("long"), F.lit(0))

    def one(name: str, when: Column, frequency: Column, impact: Column, saved: Column) -> Column:
        row = F.struct(F.lit(name).alias("id"), frequency.cast("long").alias("frequency"), F.round(impact.cast("double"), 6).alias("impact"), saved.cast("long").alias("turns_saved"))
        return F.when(when, row)

    some = F.array_compact(
        F.array(
            one("scope_vague_directives", F.col("vague") > 0, F.col("vague"), F.col("vague") * 3.0, F.col("vague") * 3),
            one("reduce_confirmation_loops", (n > 0) & (F.col("acks") / n > 0.15), F.col("acks"), extra, extra),
            one("stop_repeating", F.col("wasted") > 0, F.col("wasted"), F.col("wasted") * 1.5, F.col("wasted")),
            one("cite_file_paths", (n >= 20) & (F.col("no_file") / n > 0.30), F.col("no_file"), F.col("no_file") * 0.3, F.expr("no_file div 4")),
        )
    )
    front = one("front_load_context", (F.col("mean_words") < 10) & (n > 20), F.col("under_5_words"), F.col("under_5_words") * 0.2, F.expr("under_5_words div 5"))
    zero, always = F.lit(0), F.lit(True)
    last = F.coalesce(F.when(n == 0, one("no_data", always, zero, zero, zero)), front, one("healthy", always, zero, zero, zero))
    return f.select(F.explode(let(some, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(last)))).alias("r")).select("r.*")


def projected_savings(recommended: DataFrame, stats: DataFrame) -> DataFrame:
    """recommended with the tokens, cost and hours that the turns saved would take on average; stats: one row of turn_stats over all models."""
    s = stats.select((F.col("mean_input") + F.col("mean_output")).alias("tokens_a_turn"), "mean_cost_usd", F.lit(1).alias("only"))
    out = recommended.withColumn("only", F.lit(1)).join(s, "only")  # a handful of rows and one
    turns = F.col("turns_saved")
    return out.select("id", "turns_saved", F.floor(turns * F.col("tokens_a_turn")).cast("long").alias("tokens"), F.round(turns * F.col("mean_cost_usd"), 6).alias("cost_usd"), F.round(turns * SECONDS_A_TURN / 3600.0, 6).alias("hours"))


def turn_stats(priced: DataFrame) -> DataFrame:
    """Turns, mean tokens and mean cost, by model and (null) over all; turns without tokens don't count."""
    used = priced.filter((F.coalesce("input_tokens", F.lit(0)) > 0) | (F.coalesce("output_tokens", F.lit(0)) > 0))
    out = used.rollup("model").agg(F.count("*").alias("turns"), F.sum("input_tokens").alias("i"), F.sum("cached_input_tokens").alias("c"), F.sum("output_tokens").alias("o"), F.sum(F.col("list_price").cast("decimal(18,9)")).cast("double").alias("cost"))
    mean = lambda c, name: F.round(F.coalesce(c, F.lit(0)) / F.col("turns"), 6).alias(name)
    return out.filter("turns > 0").select("model", "turns", mean("i", "mean_input"), mean("c", "mean_cached"), mean("o", "mean_output"), mean(F.col("cost"), "mean_cost_usd"))


def merged_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of turn_stats as one: means weighted by turns."""
    both = a.unionByName(b)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("turns")) / F.sum("turns"), 6).alias(c)
    return both.groupBy("model").agg(F.sum("turns").alias("turns"), *[mean(c) for c in ("mean_input", "mean_cached", "mean_output", "mean_cost_usd")])


def reply_stats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Words of the assistant's replies without code blocks, by conversation and (null) over all.

    terse: three replies or more with hardly an article or filler; saved_tokens: what such a
    style is taken to have saved.
    """
    parts = F.split(F.coalesce("text", F.lit("")), "```")
    prose = F.when(F.size(parts) > 1, F.array_join(F.filter(parts, lambda p, i: i % 2 == 0), " ")).otherwise(F.coalesce("text", F.lit("")))
    words = F.transform(F.regexp_extract_all(prose, F.lit(WORD), F.lit(0)), F.lower)

    def counted(w: Column) -> Column:
        of = lambda names: F.size(F.filter(w, lambda x: x.isin(names)))
        return F.struct(F.size(w).alias("words"), of(ARTICLES).alias("articles"), of(FILLERS).alias("fillers"), F.length(F.array_join(w, "")).alias("letters"))

    rows = turns.filter("role = 'assistant'").select(key, let(words, counted).alias("c"), (F.size(parts) > 1).alias("code"))
    out = rows.rollup(key).agg(F.count("*").alias("replies"), *[F.sum(f"c.{c}").alias(c) for c in ("words", "articles", "fillers", "letters")], F.count_if("code").alias("coded")).filter("replies > 0")
    share = lambda c: F.when(F.col("words") > 0, F.col(c) / F.col("words")).otherwise(0.0)
    terse = (F.col("replies") >= 3) & (F.col("words") > 0) & (share("articles") < 0.025) & (share("fillers") < 0.005)
    saved = F.floor(F.floor(F.col("words") * 1.3) * (0.15 / (1 - 0.15))).cast("long")
    return out.select(
        key,
        "replies",
        "words",
        F.round(F.col("words") / F.col("replies"), 6).alias("mean_words"),
        F.round(share("letters"), 6).alias("mean_word"),
        F.round(share("articles"), 6).alias("article_share"),
        F.round(share("fillers"), 6).alias("filler_share"),
        F.round(F.when(F.col("words") > 0, F.col("coded") / F.col("replies")).otherwise(0.0), 6).alias("code_share"),
        F.coalesce(terse, F.lit(False)).alias("terse"),
        F.when(terse, saved).otherwise(0).alias("saved_tokens"),
    )


def tool_stats(events: DataFrame) -> DataFrame:
    """One row over tool events (kind use or result, id, name, command, is_error): calls, failures, destructive calls and rates.

    A call fails if its last result by ts says so; a call with several results counts once.
    """
    use, result = F.col("kind") == "use", F.col("kind") == "result"
    bad = use & (F.col("name") == "Bash") & F.col("command").rlike(DESTRUCTIVE)
    last = F.max_by(F.when(result, F.col("is_error")), F.when(result, F.col("ts")))
    by_id = events.groupBy("id").agg(F.count_if(use).alias("calls"), F.count_if(bad).alias("destructive"), F.coalesce(last, F.lit(False)).alias("failed"))
    sums = by_id.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("destructive"), F.lit(0)).alias("destructive"), F.count_if("failed").alias("failed"))
    rate = lambda x: F.round(F.coalesce(x * 100.0 / F.nullif("calls", F.lit(0)), F.lit(0.0)), 6)
    return sums.select("calls", "failed", "destructive", rate(F.col("calls") - F.col("failed")).alias("success_pct"), rate(F.col("destructive")).alias("destructive_pct"))


def tool_counts(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'use' and coalesce(name, '') <> ''").groupBy("name").agg(F.count("*").alias("calls"))


# Commands that have no output of their own.
SILENT = ["cd", "export", "source", "set", "unset", "pushd", "popd", ""]


def command_token(command: Column) -> Column:
    """The program that a shell line is about: of the parts of its chain the first that has output, without sudo, assignments and folders; empty if there is none."""

    def program(part: Column) -> Column:
        words = F.filter(F.split(F.btrim(part), r"\s+"), lambda w: (w != "sudo") & ~w.contains("="))
        return F.regexp_replace(F.coalesce(F.get(words, F.lit(0)), F.lit("")), r"^.*[/\\]", "")

    parts = F.split(F.coalesce(command, F.lit("")), r"&&|\|\||;|\n")
    return F.coalesce(F.get(F.filter(F.transform(parts, program), lambda p: ~p.isin(SILENT)), F.lit(0)), F.lit(""))


def joined_results(blocks: DataFrame) -> DataFrame:
    """Results (session, ts, id, content) with the name, command and path of the call that they answer; `unknown` if it isn't in the session."""
    uses = blocks.filter("kind = 'tool_use'").groupBy("session", "id").agg(F.max_by(F.struct("name", "command", "path", "ranged"), "ts").alias("u"))
    results = blocks.filter("kind = 'tool_result'").select("session", "ts", "id", F.coalesce("content", F.lit("")).alias("content"))
    out = results.join(uses, ["session", "id"], "left")
    return out.select("session", "ts", "id", "content", F.octet_length("content").cast("long").alias("bytes"), F.coalesce(F.nullif("u.name", F.lit("")), F.lit("unknown")).alias("name"), command_token(F.col("u.command")).alias("command"), F.coalesce("u.path", F.lit("")).alias("path"), F.coalesce("u.ranged", F.lit(False)).alias("ranged"))


def composition(blocks: DataFrame) -> DataFrame:
    """(part, bytes): results by tool, and prose of the assistant and of others."""
    tools = joined_results(blocks).groupBy(F.concat(F.lit("tool:"), F.col("name")).alias("part")).agg(F.sum("bytes").alias("bytes"))
    who = F.when(F.col("role") == "assistant", "assistant_prose").otherwise("user_prose")
    prose = blocks.filter("kind = 'text'").groupBy(who.alias("part")).agg(F.sum(F.octet_length(F.coalesce("content", F.lit("")))).cast("long").alias("bytes"))
    return tools.unionByName(prose)


def _reads(blocks: DataFrame) -> DataFrame:
    return joined_results(blocks).filter("name = 'Read' and bytes > 0")


def _by_path(reads: DataFrame) -> DataFrame:
    """(session, path, reads, wasted): wasted is what every read but the first took; sums by partial aggregation, so a hot path is no single task."""
    first = F.min_by("bytes", F.struct("ts", "id"))
    return reads.filter("path <> ''").groupBy("session", "path").agg(F.count("*").alias("reads"), (F.sum("bytes") - first).alias("wasted"))


def read_report(blocks: DataFrame) -> DataFrame:
    """One row: reads, bytes, reads of a range, bytes read again in a session, bytes whose content was read before anywhere."""
    reads = _reads(blocks)
    none = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    by_content = reads.groupBy(F.sha2("content", 256)).agg(F.count("*").alias("reads"), F.sum("bytes").alias("bytes"), F.count_if("ranged").alias("ranged"), (F.sum("bytes") - F.max("bytes")).alias("duplicate_bytes"))
    parts = by_content.select("reads", "bytes", "ranged", *none("repeat_bytes"), "duplicate_bytes")
    parts = parts.unionByName(_by_path(reads).select(*none("reads", "bytes", "ranged"), F.col("wasted").alias("repeat_bytes"), *none("duplicate_bytes")))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])


def rereads(blocks: DataFrame, top: int = 20) -> DataFrame:
    """The paths that waste most bytes by being read again in a session; ties by path."""
    by_session = _by_path(_reads(blocks)).filter("reads > 1")
    return by_session.groupBy("path").agg(F.sum("reads").alias("reads"), F.sum("wasted").alias("wasted_bytes")).filter("wasted_bytes > 0").orderBy(F.desc("wasted_bytes"), "path").limit(top)


def read_extensions(blocks: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return _reads(blocks).filter("path <> ''").groupBy(F.when(ext == "", "(none)").otherwise(ext).alias("ext")).agg(F.sum("bytes").alias("bytes"))


def weekly_timeline(blocks: DataFrame, usage: DataFrame) -> DataFrame:
    """By week from Monday: tokens of usage (ts, input_tokens, output_tokens), bytes of Read, Bash and other results, and of the assistant's prose."""
    week = F.date_trunc("week", "ts").cast("date").alias("week")
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    tokens = usage.groupBy(week).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), *zero("read_bytes", "bash_bytes", "other_bytes", "prose_bytes"))
    of = lambda on: F.sum(F.when(on, F.col("bytes")).otherwise(0))
    name = F.col("name")
    results = joined_results(blocks).groupBy(week).agg(*zero("input_tokens", "output_tokens"), of(name == "Read").alias("read_bytes"), of(name == "Bash").alias("bash_bytes"), of(~name.isin("Read", "Bash")).alias("other_bytes"), *zero("prose_bytes"))
    prose = blocks.filter("kind = 'text' and role = 'assistant'").groupBy(week).agg(*zero("input_tokens", "output_tokens", "read_bytes", "bash_bytes", "other_bytes"), F.sum(F.octet_length("content")).cast("long").alias("prose_bytes"))
    columns = ["input_tokens", "output_tokens", "read_bytes", "bash_bytes", "other_bytes", "prose_bytes"]
    return tokens.unionByName(results).unionByName(prose).filter("week is not null").groupBy("week").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def command_roi(blocks: DataFrame) -> DataFrame:
    """(command, runs, raw_bytes, saved_balanced, saved_aggressive) of the shell's output: what its tools' rules would save."""
    from .tool_output import reduced

    runs = joined_results(blocks).filter("name = 'Bash' and bytes > 0").select(F.coalesce(F.nullif("command", F.lit("")), F.lit("unknown")).alias("command"), "content", "bytes")
    for level in ("balanced", "aggressive"):
        r = reduced(F.col("content"), F.col("command"), F.lit(level))
        runs = runs.withColumn("r", r).withColumn(f"saved_{level}", F.when(F.col("r.critical_kept"), F.greatest(F.col("r.bytes_before") - F.col("r.bytes_after"), F.lit(0))).otherwise(0)).drop("r")
    return runs.groupBy("command").agg(F.count("*").alias("runs"), F.sum("bytes").alias("raw_bytes"), F.sum("saved_balanced").alias("saved_balanced"), F.sum("saved_aggressive").alias("saved_aggressive"))

"""How well reductions do: learning from telemetry, evaluation reports and their gate, coverage debt, replay, routing, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing
from .spend import exact_sum


def command_learning(records: DataFrame, least_runs: int = 5, generic_floor: float = 0.5, ceiling: float = 0.10, floor: float = 0.01) -> DataFrame:
    """(command, runs, generic_runs, accesses, raw_bytes, tokens_saved, generic_ratio, access_rate, next_formatter, critical_miss, hint).

    records: type (compress or access), id, command, raw_bytes, tokens_saved, handled,
    generic_fallback, ts. An access counts for the command of the last compression of its id, else
    for its own. hint: lower or raise the level, null to keep it or where only generic rules ran.
    """
    runs = records.filter("type = 'compress'")
    generic = ~F.coalesce("handled", F.lit(False)) | F.coalesce("generic_fallback", F.lit(False))
    ran = runs.groupBy("command").agg(F.count("*").alias("runs"), F.count_if(generic).alias("generic_runs"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"))
    owner = runs.filter("coalesce(id, '') <> ''").groupBy("id").agg(F.max_by("command", "ts").alias("owner"))
    met = records.filter("type = 'access'").join(owner, "id", "left").select(F.coalesce("owner", "command", F.lit("")).alias("command")).filter("command <> ''").groupBy("command").agg(F.count("*").alias("accesses"))
    both = ran.join(met, "command", "full_outer").fillna(0)
    ratio = lambda c: F.round(F.coalesce(F.col(c) / F.nullif("runs", F.lit(0)), F.lit(0.0)), 6)
    out = both.withColumns({"generic_ratio": ratio("generic_runs"), "access_rate": ratio("accesses")})
    enough = F.col("runs") >= least_runs
    hint = F.when(~enough | (F.col("generic_ratio") >= 1), None).when(F.col("access_rate") > ceiling, "lower").when(F.col("access_rate") <= floor, "raise")
    return out.withColumns({"next_formatter": enough & (F.col("generic_ratio") >= generic_floor), "critical_miss": enough & (F.col("access_rate") > ceiling), "hint": hint})


def step_passes(quality: Column, saved: Column, input_tokens: Column, decision: Column, least_quality: Column, least_ratio: Column, must: Column) -> Column:
    """Whether a step of an evaluation meets what is expected of it; 0 or null asks nothing."""
    bad = (F.coalesce(least_quality, F.lit(0.0)) > 0) & (quality < least_quality)
    small = (F.coalesce(least_ratio, F.lit(0.0)) > 0) & (input_tokens > 0) & (saved / input_tokens < least_ratio)
    silent = F.coalesce(must, F.lit(False)) & (decision == "skipped") & (saved == 0)
    return ~(bad | small | silent)


def eval_report(steps: DataFrame) -> DataFrame:
    """By optimizer and (null) over all: cases, passed, success_pct, mean_quality, saved, apply_pct. An empty name is `unknown`."""
    named = steps.withColumn("optimizer", F.coalesce(F.nullif("optimizer", F.lit("")), F.lit("unknown")))
    out = named.rollup("optimizer").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.avg("quality").alias("q"), F.sum("saved").alias("saved"), F.count_if(F.col("decision") == "applied").alias("applied"))
    pct = lambda c: F.round(F.col(c) * 100.0 / F.col("cases"), 6)
    return out.filter("cases > 0").select("optimizer", "cases", "passed", pct("passed").alias("success_pct"), F.round("q", 6).alias("mean_quality"), "saved", pct("applied").alias("apply_pct"))


def merged_reports(*reports: DataFrame) -> DataFrame:
    """Reports as one: counts and savings summed, means weighted by cases."""
    both = reports[0]
    for r in reports[1:]:
        both = both.unionByName(r)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("cases")) / F.sum("cases"), 6).alias(c)
    return both.groupBy("optimizer").agg(F.sum("cases").alias("cases"), F.sum("passed").alias("passed"), mean("success_pct"), mean("mean_quality"), F.sum("saved").alias("saved"), mean("apply_pct"))


def gate(baseline: DataFrame, current: DataFrame, most_drop: float = 5.0, most_drift: float = 10.0, least_cases: int = 1) -> DataFrame:
    """(violation, optimizer, observed, bound): what keeps a current eval_report from passing against a baseline; no rows: it passes."""
    now = current.select("optimizer", F.col("cases").alias("n"), F.col("success_pct").alias("s"), F.col("mean_quality").alias("q"))
    both = baseline.alias("b").join(now.alias("c"), F.expr("b.optimizer <=> c.optimizer"), "left").select("b.*", "n", "s", "q")
    row = lambda name, on, observed, bound: F.when(on, F.struct(F.lit(name).alias("violation"), F.round(observed.cast("double"), 6).alias("observed"), F.lit(float(bound)).alias("bound")))
    whole, drift = F.col("optimizer").isNull(), (F.col("q") - F.col("mean_quality")) / F.nullif("mean_quality", F.lit(0.0)) * 100
    found = F.array_compact(
        F.array(
            row("missing_current", whole & F.col("n").isNull(), F.lit(0), 0),
            row("under_covered", whole & (F.col("n") < least_cases), F.col("n"), least_cases),
            row("success_rate_drop", whole & (F.col("success_pct") - F.col("s") > most_drop), F.col("success_pct") - F.col("s"), most_drop),
            row("optimizer_disappeared", ~whole & F.col("n").isNull(), F.lit(0), 0),
            row("quality_drift", ~whole & (drift < -most_drift), drift, -most_drift),
        )
    )
    return both.select("optimizer", F.explode(found).alias("v")).select("v.violation", "optimizer", "v.observed", "v.bound")


def coverage(lines: DataFrame) -> DataFrame:
    """(package, statements, covered) of the lines of coverage profiles (value): file:span statements count."""
    at = lambda n: F.regexp_extract("value", r"^(.+):\S+\s+(\d+)\s+(\d+)$", n)
    rows = lines.filter(F.col("value").rlike(r"^.+:\S+\s+\d+\s+\d+$")).select(at(1).alias("file"), at(2).cast("long").alias("statements"), at(3).cast("long").alias("hits"))
    package = F.when(F.col("file").rlike("^.+/"), F.regexp_extract("file", "^(.+)/[^/]*$", 1)).otherwise(F.col("file"))
    return rows.groupBy(package.alias("package")).agg(F.sum("statements").alias("statements"), F.sum(F.when(F.col("hits") > 0, F.col("statements")).otherwise(0)).alias("covered"))


def coverage_debt(covered: DataFrame, policies: DataFrame, risk: int = 4, goal: float = 60.0) -> DataFrame:
    """(package, risk, coverage_pct, goal, risk_score, gap, goal_met) by policies (package, risk, goal); packages without one have the defaults."""
    pct = F.coalesce(F.col("covered") * 100.0 / F.nullif("statements", F.lit(0)), F.lit(0.0))
    rows = covered.join(policies, "package", "left").select("package", F.coalesce("risk", F.lit(risk)).alias("risk"), pct.alias("pct"), F.coalesce("goal", F.lit(goal)).alias("goal"))
    return rows.select("package", "risk", F.round("pct", 6).alias("coverage_pct"), "goal", F.round(F.col("risk") * (1 - F.col("pct") / 100), 6).alias("risk_score"), F.round(F.greatest(F.col("goal") - F.col("pct"), F.lit(0.0)), 6).alias("gap"), ((F.col("goal") == 0) | (F.col("pct") >= F.col("goal"))).alias("goal_met"))


def overall_coverage(debt: DataFrame) -> DataFrame:
    """One row: coverage weighted by risk, the sum of risks, and packages short of their goal."""
    return debt.agg(F.round(F.coalesce(F.sum(F.col("coverage_pct") * F.col("risk")) / F.nullif(F.sum("risk"), F.lit(0)), F.lit(0.0)), 6).alias("overall_pct"), F.coalesce(F.sum("risk"), F.lit(0)).cast("long").alias("risk"), F.count_if(~F.col("goal_met")).alias("short"))


def replay_totals(steps: DataFrame) -> DataFrame:
    """One row over replayed requests: how many, with a recommendation, tokens and cost saved."""
    return steps.agg(F.count("*").alias("requests"), F.count_if(F.col("target").isNotNull()).alias("recommended"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), exact_sum("saved_usd").alias("saved_usd"))


def routed(requests: DataFrame, rules: DataFrame, card: DataFrame, available: list[str] | None = None, least_quality: float = 0.0) -> DataFrame:
    """requests with target, quality, saved_tokens and saved_usd: where the first rule that fits would send them.

    rules: nr (order), provider, pattern (exact or prefix*), to_model, fallbacks (array), quality.
    The target is the first of to_model and fallbacks that is available (None: all are). No rule,
    one below least_quality, or none available: null. No saving: 0. Rules are a small table,
    sent as one row for each provider.
    """
    starred = F.col("pattern").endswith("*")
    entry = F.struct("nr", starred.alias("starred"), F.when(starred, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern")).alias("prefix"), F.concat(F.array("to_model"), F.coalesce("fallbacks", F.array().cast("array<string>"))).alias("targets"), "quality")
    by = rules.groupBy(F.col("provider").alias("rule_provider")).agg(F.array_sort(F.collect_list(entry)).alias("rules"))
    fits = lambda e: (e["prefix"] == F.col("model")) | (e["starred"] & F.col("model").startswith(e["prefix"]))
    usable = lambda t: (F.coalesce(t, F.lit("")) != "") & (t.isin(available) if available is not None else F.lit(True))
    out = requests.join(F.broadcast(by), F.col("provider") == F.col("rule_provider"), "left").withColumn("rule", F.get(F.filter("rules", fits), F.lit(0)))
    out = out.withColumn("quality", F.when(F.col("rule.quality") >= least_quality, F.col("rule.quality")))
    out = out.withColumn("target", F.when(F.col("quality").isNotNull(), F.get(F.filter("rule.targets", usable), F.lit(0)))).drop("rule", "rules", "rule_provider")
    free = {"cost_usd": F.lit(None).cast("double"), "cost_source": F.lit("metered")}
    keep = [c for c in requests.columns if c not in ("cost_usd", "cost_source", "cached_input_tokens")]
    base = out.select(*keep, "quality", "target").withColumns({**free, "cached_input_tokens": F.lit(0).cast("long")})
    was = pricing.rated(base, card).withColumn("was", pricing.cost(F.col("input_tokens"), F.lit(0), F.col("output_tokens"))).drop(*pricing.RATES)
    moved = was.withColumnRenamed("model", "asked").withColumn("model", F.coalesce("target", "asked"))
    now = pricing.rated(moved, card).withColumn("now", pricing.cost(F.col("input_tokens"), F.lit(0), F.col("output_tokens"))).drop(*pricing.RATES, "model").withColumnRenamed("asked", "model")
    saved = F.when(F.col("target").isNotNull(), F.greatest(F.col("was") - F.col("now"), F.lit(0.0)))
    return now.select(*keep, "target", "quality", F.when(saved > 0, F.col("input_tokens") + F.col("output_tokens")).otherwise(0).alias("saved_tokens"), F.round(F.coalesce(saved, F.lit(0.0)), 9).alias("saved_usd"))


def decision(mode: Column, accepted: Column, has_change: Column) -> Column:
    """What becomes of a recommendation. Interactively: applied if accepted, accepted if there is nothing to apply, else rejected (also if nobody was asked); in all other modes it is only seen: skipped."""
    asked = F.when(~F.coalesce(accepted, F.lit(False)), "rejected").when(has_change, "applied").otherwise("accepted")
    return F.when(mode == "interactive", asked).otherwise("skipped")


def quality_gated(recommended: DataFrame, least: float = 0.85) -> DataFrame:
    """recommended with withheld: whether quality is below least, so that nothing is applied but it is still reported."""
    return recommended.withColumn("withheld", F.coalesce(F.col("quality"), F.lit(0.0)) < least)


def dedupe_quality(clusters: Column) -> Column:
    return F.when(clusters <= 1, 0.95).when(clusters <= 3, 0.9).otherwise(0.85)


def compress_quality(before: Column, after: Column) -> Column:
    """By the share of bytes left: half and a half of it, 0.95 at most; 1 for an empty text."""
    return F.when(before == 0, 1.0).otherwise(F.least(F.lit(0.95), 0.5 + 0.5 * after / before))


def trim_quality(dropped: Column) -> Column:
    """By the number of messages dropped, 0.6 at least."""
    return F.greatest(F.lit(0.6), 0.95 - 0.02 * dropped)


#: Chunks are cut by position only, so the cut is held to be unsure.
PRUNE_QUALITY = 0.6


def saved_tokens(before: Column, after: Column, before_bytes: Column, after_bytes: Column) -> Column:
    """Tokens saved, not below 0; a fourth of the bytes saved where the tokens aren't known."""
    return F.greatest(F.coalesce(before - after, F.floor((before_bytes - after_bytes) / 4).cast("long")), F.lit(0))

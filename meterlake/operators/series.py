"""Windows over ordered series: anomalies, forecasts, workflow steps, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _severity(z: Column, threshold: float) -> Column:
    return F.when(z >= 2 * threshold, "high").when(z >= 1.5 * threshold, "medium").when(z >= threshold, "low").otherwise("none")


def rolling_anomalies(series: DataFrame, key: str, threshold: float = 3.0, back: int = 12, least: int = 4) -> DataFrame:
    """Points whose value is threshold sample deviations over the mean of up to `back` points before them.

    A baseline without deviation: a value outside half and one and a half of it counts, with z 0
    and no severity, dips too.
    """
    w = Window.partitionBy(key).orderBy("at").rowsBetween(-back, -1)
    out = series.withColumns({"n": F.count("value").over(w), "mean": F.avg("value").over(w), "sd": F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0))}).filter(F.col("n") >= least)
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    off = (F.col("value") > F.col("mean") * 1.5) | (F.col("value") < F.col("mean") * 0.5)
    out = out.withColumn("z", z).filter(F.when(F.col("sd") > 0, F.col("z") >= threshold).otherwise(off))
    return out.select(key, "at", "value", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"), _severity(F.col("z"), threshold).alias("severity"))


def fixed_anomalies(series: DataFrame, key: str, threshold: float = 2.0) -> DataFrame:
    """Points threshold deviations over the mean of their whole series."""
    w = Window.partitionBy(key)
    out = series.withColumns({"mean": F.avg("value").over(w), "sd": F.stddev_samp("value").over(w)})
    out = out.withColumn("z", (F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).filter(F.col("z") >= threshold)
    return out.select(key, "at", "value", F.round("z", 6).alias("z"), _severity(F.col("z"), threshold).alias("severity"))


Z95 = 1.96


def _banded(df: DataFrame, key: str, value: Column, width: Column) -> DataFrame:
    """key, step, predicted, lower and upper, each not below 0."""
    shown = lambda x, name: F.round(F.greatest(F.lit(0.0), x), 4).alias(name)
    return df.select(key, "step", shown(value, "predicted"), shown(value - width, "lower"), shown(value + width, "upper"))


def linear_forecast(series: DataFrame, key: str, horizon: int = 3) -> DataFrame:
    """Least-squares line over the index of each series, `horizon` points on, with the 95 % band of its residuals (n - 2 degrees; none for two points)."""
    x = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    sums = [F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("base"), F.count("*").alias("n"), F.regr_syy("value", "x").alias("syy"), F.regr_sxy("value", "x").alias("sxy"), F.regr_sxx("value", "x").alias("sxx")]
    fit = series.withColumn("x", x).groupBy(key).agg(*sums).filter("n >= 2")
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    sigma = F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2))).otherwise(0.0)
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return _banded(ahead, key, F.col("base") + F.col("slope") * (F.col("n") - 1 + F.col("step")), Z95 * sigma)


def holt_forecast(series: DataFrame, key: str, alpha: float = 0.6, beta: float = 0.3, horizon: int = 3) -> DataFrame:
    """Double exponential smoothing as a fold over each series in time order, with a 95 % band that widens by the root of the step.

    Series are bucketed first, so arrays stay short.
    """
    points = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"])
    folded = series.groupBy(key).agg(points.alias("v")).filter(F.size("v") >= 2)
    start = F.struct(F.get("v", F.lit(0)).alias("l"), (F.get("v", F.lit(1)) - F.get("v", F.lit(0))).alias("t"), F.lit(0.0).alias("ss"))

    def step(s: Column, v: Column) -> Column:
        guess = s["l"] + s["t"]
        level = alpha * v + (1 - alpha) * guess
        return F.struct(level.alias("l"), (beta * (level - s["l"]) + (1 - beta) * s["t"]).alias("t"), (s["ss"] + (v - guess) * (v - guess)).alias("ss"))

    out = folded.withColumn("s", F.aggregate(F.slice("v", 2, F.size("v")), start, step)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    n = F.size("v")
    sigma = F.when(n > 2, F.sqrt(F.col("s.ss") / (n - 2))).otherwise(0.0)
    return _banded(out, key, F.col("s.l") + F.col("step") * F.col("s.t"), Z95 * sigma * F.sqrt(F.col("step").cast("double")))


def _owned(events: DataFrame) -> DataFrame:
    """Events that belong to a workflow; those without one are no workflow of their own."""
    return events.filter("workflow_id <> ''")


def steps(events: DataFrame) -> DataFrame:
    """Each request of a workflow in time order with its growth of input and the seconds since the one before."""
    w = Window.partitionBy("workflow_id").orderBy("ts", "event_id")
    return _owned(events).select(
        "workflow_id",
        "event_id",
        F.row_number().over(w).alias("step"),
        (F.col("input_tokens") - F.lag("input_tokens").over(w)).alias("growth"),
        F.expr("timestampdiff(second, lag(ts) over (partition by workflow_id order by ts, event_id), ts)").alias("gap_s"),
    )


def facts(events: DataFrame) -> DataFrame:
    """A row for each workflow, all its facts from one shuffle by workflow_id and one sort.

    steps, input_tokens, output_tokens, max_context, cost_usd (if events are priced), models,
    agents, growth (of input, where positive), seconds from first to last step, agent_id and run
    (the longest run of one agent; a step without agent ends a run; ties: the first), first_repeat
    and repeated (the first step whose prompt is that of the step before, and that prompt).
    """
    kinds = {"input_tokens": "long", "output_tokens": "long", "model": "string", "agent_id": "string", "prompt_hash": "string"}
    events = events.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in events.columns})
    w = Window.partitionBy("workflow_id").orderBy("ts", "event_id")
    steps_ = _owned(events).withColumns(
        {
            "step": F.row_number().over(w),
            "grown": F.greatest(F.col("input_tokens") - F.lag("input_tokens").over(w), F.lit(0)),
            "again": F.lag("prompt_hash").over(w) == F.col("prompt_hash"),
            "turn": F.when(F.col("agent_id").eqNullSafe(F.lag("agent_id").over(w)), 0).otherwise(1),
        }
    ).withColumn("island", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    has_cost = "cost" in events.columns
    money = F.sum(F.col("cost").cast("decimal(18,9)")) if has_cost else F.lit(0)
    runs = steps_.groupBy("workflow_id", "island").agg(
        F.first("agent_id").alias("agent_id"),
        F.count("*").alias("steps"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.max("input_tokens").alias("max_context"),
        money.alias("cost"),
        F.collect_set("model").alias("models"),
        F.sum("grown").alias("grown"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min(F.when(F.col("again"), F.struct("step", "prompt_hash"))).alias("repeat"),
    )
    best = F.max_by(F.struct("agent_id", F.col("steps").alias("run")), F.when(F.col("agent_id").isNotNull(), F.struct("steps", -F.col("island"))))
    out = runs.groupBy("workflow_id").agg(
        F.sum("steps").alias("steps"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.max("max_context").alias("max_context"),
        F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("cost_usd"),
        F.size(F.array_distinct(F.flatten(F.collect_list("models")))).cast("long").alias("models"),
        F.size(F.collect_set("agent_id")).cast("long").alias("agents"),
        F.coalesce(F.sum("grown"), F.lit(0)).alias("growth"),
        F.expr("timestampdiff(second, min(first_ts), max(last_ts))").alias("seconds"),
        best.alias("best"),
        F.min("repeat").alias("repeat"),
    )
    return out.select("workflow_id", "steps", "input_tokens", "output_tokens", "max_context", *(["cost_usd"] if has_cost else []), "models", "agents", "growth", "seconds", F.col("best.agent_id").alias("agent_id"), F.coalesce("best.run", F.lit(0)).alias("run"), F.col("repeat.step").alias("first_repeat"), F.col("repeat.prompt_hash").alias("repeated"))


def histograms(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each key a map from value to count for each of columns; null values are left out. Counted before they are put together."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = events.select(key, kinds.alias("h")).filter("h.value is not null").groupBy(key, "h.kind", "h.value").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("value", "n"))))).alias(f"{c}_counts") for c in columns])


def traces(priced: DataFrame) -> DataFrame:
    """A row for each workflow: steps, tokens, cost, positive growth, duration, models and agents."""
    return facts(priced).drop("agent_id", "run", "first_repeat", "repeated")


def longest_runs(events: DataFrame) -> DataFrame:
    """The longest run of requests of one agent in each workflow; a request without agent ends a run. Ties: the first run."""
    return facts(events).filter("agent_id is not null").select("workflow_id", "agent_id", "run")


def first_repeats(events: DataFrame) -> DataFrame:
    """The first step of each workflow whose prompt is that of the step before."""
    return facts(events).filter("first_repeat is not null").select("workflow_id", F.col("first_repeat").alias("step"), F.col("repeated").alias("prompt_hash"))


def upper_medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """The upper median of each key's values. Values are counted first, so a window holds a row for each distinct one."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    out = counts.withColumns({"till": F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    return out.filter("till >= n div 2 + 1").groupBy(key).agg(F.min(value).alias("upper_median"))


def latest(events: DataFrame, key: str, column: str) -> DataFrame:
    """The last non-null value of each key and when it was; ties by the smaller event_id."""
    return events.filter(F.col(column).isNotNull()).groupBy(key).agg(F.max_by(F.struct("ts", column), F.struct("ts", -F.col("event_id"))).alias("l")).select(key, F.col("l.ts").alias("ts"), F.col(f"l.{column}").alias(column))

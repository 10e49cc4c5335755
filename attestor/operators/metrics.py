"""Evaluation: retrieval at k, signed document value, Wilson and bootstrap intervals, strategy reports, oracle scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(empty))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % bounds of a share; 0 and 1 without observations."""
    p, z2 = successes.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)), Z * Z
    m = n.cast("double")
    centre, spread = (p + z2 / (2 * m)) / (1 + z2 / m), (F.lit(Z) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)
    return F.coalesce(F.greatest(F.lit(0.0), centre - spread), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + spread), F.lit(1.0))


def retrieval_at_k(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row: questions, recall (mean share of gold in the top k), complete (share with all gold), precision (share of
    the top k that adds new gold). Questions without gold are left out; without results they score 0."""
    top = results.filter(F.col("rank") <= k).join(gold.select("question_id", "source_id", F.lit(1).alias("hit")), ["question_id", "source_id"], "left")
    w = Window.partitionBy("question_id", "source_id").orderBy("rank")
    fresh = top.withColumn("new", F.when((F.col("hit") == 1) & (F.row_number().over(w) == 1), 1).otherwise(0))
    per = fresh.groupBy("question_id").agg(F.sum("new").alias("found"), F.count(F.lit(1)).alias("returned"))
    want = gold.groupBy("question_id").agg(F.countDistinct("source_id").alias("n"))
    q = want.join(per, "question_id", "left").select("n", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("returned", F.lit(0)).alias("returned"))
    return q.agg(F.count(F.lit(1)).alias("questions"), F.avg(F.col("found") / F.col("n")).alias("recall"), F.avg((F.col("found") == F.col("n")).cast("double")).alias("complete"), F.avg(ratio(F.col("found"), F.col("returned"), 0.0)).alias("precision"))


def dvaa(claims: DataFrame, harmful: DataFrame, adopted: DataFrame) -> DataFrame:
    """(question_id, value) in -1..1: the weighted share of required claims (question_id, claim_id, weight, source_id
    acceptable) with an adopted acceptable document, less the penalties of adopted harmful ones, at most 1."""
    hit = claims.join(adopted.withColumn("on", F.lit(1)), ["question_id", "source_id"], "left").groupBy("question_id", "claim_id").agg(F.max("weight").alias("weight"), F.coalesce(F.max("on"), F.lit(0)).alias("covered"))
    p = hit.groupBy("question_id").agg((F.sum(F.col("weight") * F.col("covered")) / F.sum("weight")).alias("p"))
    h = harmful.join(adopted.distinct(), ["question_id", "source_id"]).groupBy("question_id").agg(F.least(F.lit(1.0), F.sum("penalty")).alias("h"))
    return p.join(h, "question_id", "left").select("question_id", (F.col("p") - F.coalesce("h", F.lit(0.0))).alias("value"))


def bootstrap_mean(values: DataFrame, column: str, iterations: int = 2000, seed: int = 1) -> DataFrame:
    """(mean, low, high): 95 % percentile bootstrap by the Poisson scheme: each row counts Poisson(1) times in each of
    the iterations, drawn from a digest of its other columns and the iteration, so no resample is gathered anywhere.
    Rows meet their iterations inside the aggregation, which combines in each task: what is shuffled is one row per
    iteration and task. Null values take no part."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in values.columns if c != column])
    rows = values.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), key.alias("k")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    draw = F.md5(F.concat_ws("|", "k", F.col("i").cast("string"), F.lit(str(seed))).cast("binary"))
    u = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / float(1 << 32)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    n = sum((F.when(F.col("u") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    means = rows.withColumn("u", u).withColumn("n", n).groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    bounds = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return values.agg(F.avg(column).alias("mean")).crossJoin(bounds)  # two tables of one row each


def paired_bootstrap(pairs: DataFrame, left: str, right: str, **options) -> DataFrame:
    keys = [c for c in pairs.columns if c not in (left, right)]
    return bootstrap_mean(pairs.select(*keys, (F.col(left) - F.col(right)).alias("difference")), "difference", **options)


def strategy_summary(runs: DataFrame) -> DataFrame:
    """By strategy: runs, mean, p50 and p95 of seconds (floor index), share completed."""
    w = Window.partitionBy("strategy")
    r = runs.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("seconds", "run_id")) - 1)
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("seconds")))
    return r.groupBy("strategy").agg(F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean_seconds"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.avg((F.col("status") == "completed").cast("double")).alias("completed"))


def paired_comparison(runs: DataFrame, baseline: str) -> DataFrame:
    """Latest run of each (domain, strategy) against the baseline strategy's latest of the same domain."""
    w = Window.partitionBy("domain", "strategy").orderBy(F.desc("run_id"))
    last = runs.withColumn("n", F.row_number().over(w)).filter("n = 1")
    base = last.filter(F.col("strategy") == baseline).select("domain", F.col("seconds").alias("base_seconds"))
    return last.filter(F.col("strategy") != baseline).join(base, "domain").select("domain", "strategy", "seconds", "base_seconds", (F.col("seconds") / F.col("base_seconds")).alias("ratio"))


def relation_pr(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision and recall of distinct (source_id, target_id, kind)."""
    key = ["source_id", "target_id", "kind"]
    f, g = found.select(*key).distinct(), gold.select(*key).distinct()
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    one = n(f, "found").crossJoin(n(g, "gold")).crossJoin(n(f.intersect(g), "correct"))  # tables of one row each
    return one.select("found", "gold", "correct", ratio(F.col("correct"), F.col("found")).alias("precision"), ratio(F.col("correct"), F.col("gold")).alias("recall"))


def oracle_metrics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """By category and in total (category null): decisions, decision accuracy, strict cases, reason recall, and accuracy
    where the expected disposition is unresolved."""
    j = expected.join(actual.select("case_id", "source_id", F.col("disposition").alias("got"), F.col("reasons").alias("got_reasons")), ["case_id", "source_id"], "left")
    ok = F.coalesce(F.col("got") == F.col("disposition"), F.lit(False))
    none = F.array().cast("array<string>")
    j = j.withColumn("ok", ok.cast("int")).withColumn("want", F.size(F.coalesce("reasons", none))).withColumn("have", F.size(F.array_intersect(F.coalesce("reasons", none), F.coalesce("got_reasons", none))))
    case = j.groupBy("category", "case_id").agg(F.min("ok").alias("strict"), F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("n"), F.sum("want").alias("want"), F.sum("have").alias("have"), F.sum((F.col("disposition") == "unresolved").cast("int")).alias("abstain"), F.sum((F.col("disposition") == "unresolved").cast("int") * F.col("ok")).alias("abstain_ok"))
    return case.rollup("category").agg(F.sum("n").alias("decisions"), ratio(F.sum("ok"), F.sum("n")).alias("decision_accuracy"), F.avg(F.col("strict").cast("double")).alias("strict_accuracy"), ratio(F.sum("have"), F.sum("want")).alias("reason_recall"), ratio(F.sum("abstain_ok"), F.sum("abstain")).alias("abstention_accuracy"))


def oracle_problems(profiles: DataFrame, candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(code, id): repeated profiles and candidates, candidates without a profile, expectations that are no candidates."""
    twice = lambda df, keys, code: df.groupBy(*keys).count().filter("count > 1").select(F.lit(code).alias("code"), F.concat_ws("/", *keys).alias("id"))
    lost = candidates.join(profiles.select("source_id"), "source_id", "left_anti").select(F.lit("profile_missing").alias("code"), F.concat_ws("/", "case_id", "source_id").alias("id"))
    stray = expected.join(candidates.select("case_id", "source_id"), ["case_id", "source_id"], "left_anti").select(F.lit("expected_not_candidate").alias("code"), F.concat_ws("/", "case_id", "source_id").alias("id"))
    return twice(profiles, ["source_id"], "profile_repeated").unionByName(twice(candidates, ["case_id", "source_id"], "candidate_repeated")).unionByName(lost.distinct()).unionByName(stray.distinct())


def extraction_metrics(gold: DataFrame, found: DataFrame, fields: list[str], rank: str = "authority_rank") -> DataFrame:
    """One row: coverage, accuracy of each field among covered profiles, and the mean error of the rank."""
    right = found.select("source_id", *[F.col(c).alias(f"f_{c}") for c in (*fields, rank)], F.lit(1).alias("there"))
    j = gold.join(right, "source_id", "left")
    same = [F.avg(F.when(F.col("there") == 1, F.col(c).eqNullSafe(F.col(f"f_{c}")).cast("double"))).alias(f"{c}_accuracy") for c in fields]
    return j.agg(F.avg(F.coalesce("there", F.lit(0)).cast("double")).alias("coverage"), *same, F.avg(F.abs(F.col(rank) - F.col(f"f_{rank}")).cast("double")).alias("rank_error"))


def scope_values(values: Column) -> Column:
    """Lower case, trimmed, without empty, null and all, sorted and distinct: how evaluation compares scope values."""
    clean = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda v: ~v.isin("", "null", "all"))))


def metric_interval(values: DataFrame, column: str, **options) -> DataFrame:
    """(n, mean, low, high): Wilson bounds if all values are 0 or 1, else bootstrap ones."""
    row = values.agg(F.count(column).alias("n"), F.sum(column).alias("s"), F.avg(column).alias("mean"), F.min(F.col(column).isin(0, 1)).alias("binary"))
    if row.first()["binary"]:
        low, high = wilson(F.col("s"), F.col("n"))
        return row.select("n", "mean", low.alias("low"), high.alias("high"))
    return row.select("n").crossJoin(bootstrap_mean(values, column, **options))  # two tables of one row each


def corpus_inventory(files: DataFrame, units: DataFrame) -> DataFrame:
    """One row for files (path, format, content_hash, text) and their units: documents, formats (name:count, sorted),
    characters, units, groups of exact duplicates, duplicates beyond the first of each, and their ratio."""
    groups = files.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    formats = files.groupBy("format").count().agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "format", F.col("count").cast("string")))), ",").alias("formats"))
    total = files.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("characters"))
    row = total.crossJoin(groups).crossJoin(formats).crossJoin(units.agg(F.count(F.lit(1)).alias("units")))  # tables of one row each
    return row.withColumn("duplicate_ratio", F.round(F.when(F.col("documents") > 0, F.col("duplicates") / F.col("documents")).otherwise(0.0), 4))


def inventory_problems(inventory: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(measure, value) of the inventory that lies outside of its bounds."""
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for m, (low, high) in bounds.items()])
    return inventory.select(F.explode(rows).alias("x")).select("x.*").filter("value < low OR value > high").select("measure", "value")

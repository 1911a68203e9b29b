"""Request metrics: counters, cumulative latency buckets, hit ratios, percentile summaries, a text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Routes and upper bounds in milliseconds.
ROUTES = ["/health", "/metrics", "/v1/formats", "/v1/extract/url", "/v1/extract/bytes", "/v1/ocr", "unmatched"]
CACHE_ROUTES = ["/v1/extract/url", "/v1/extract/bytes"]
BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000, 5000]


def route_label(path):
    return F.when(path.isin(ROUTES[:-1]), path).otherwise("unmatched")


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("route", "status").agg(F.count("*").alias("requests"))


def _routes(log: DataFrame, names: list[str]) -> DataFrame:
    return log.sparkSession.createDataFrame([(r,) for r in names], "route string")


def latency_histogram(log: DataFrame, routes: list[str] = ROUTES) -> DataFrame:
    """route, le, cumulative, for every known route; one pass, one row a route before the bounds are spread."""
    counts = log.groupBy("route").agg(*[F.count_if(F.col("latency_ms") <= b).alias(f"b{b}") for b in BOUNDS], F.count("*").alias("b_inf"))
    filled = _routes(log, routes).join(counts, "route", "left")
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.coalesce(f"b{b}", F.lit(0)).alias("cumulative")) for b in BOUNDS]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.coalesce("b_inf", F.lit(0)).alias("cumulative")))
    return filled.select("route", F.inline(F.array(*pairs)))


def latency_totals(log: DataFrame, routes: list[str] = ROUTES) -> DataFrame:
    sums = log.groupBy("route").agg(F.sum("latency_ms").alias("sum_ms"), F.count("*").alias("requests"))
    return _routes(log, routes).join(sums, "route", "left").select("route", F.coalesce("sum_ms", F.lit(0)).alias("sum_ms"), F.coalesce("requests", F.lit(0)).alias("requests"))


def hit_ratio(log: DataFrame, routes: list[str] = CACHE_ROUTES) -> DataFrame:
    """hits, misses and hits / (hits + misses), 0 without any."""
    sums = log.groupBy("route").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    rows = _routes(log, routes).join(sums, "route", "left").select("route", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("misses", F.lit(0)).alias("misses"))
    return rows.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)), 6))


def ocr_counters(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("route") == "/v1/ocr").alias("ocr_requests"), F.count_if("ocr_used").alias("ocr_usage"))


def nearest_rank(log: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """count, min, max, mean and order statistics at round((n - 1) * q), half up.

    Counts by distinct value first: the window runs over those, not over all rows of a group."""
    counts = log.groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(value)
    placed = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    at = {k: F.floor((F.col("total") - 1) * F.lit(q) + 0.5) for k, q in quantiles.items()}
    picks = [F.min(F.when(F.col("upto") > x, F.col(value))).alias(k) for k, x in at.items()]
    return placed.groupBy(by).agg(
        F.sum("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), *picks
    )


def exposition(log: DataFrame, prefix: str = "docloom") -> DataFrame:
    """The metrics as lines of text in a fixed order: (line_number, line)."""
    part = lambda df, n, sort, line: df.select(F.lit(n).alias("a"), F.array(*sort).alias("b"), line.alias("line"))
    pos = lambda names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col("route")).cast("string")
    heads = [("requests_total", "counter"), ("request_duration_ms", "histogram"), ("cache_hits_total", "counter"), ("cache_misses_total", "counter"), ("cache_hit_ratio", "gauge")]
    rows = [(2 * i, [""], f"# TYPE {prefix}_{name} {kind}") for i, (name, kind) in enumerate(heads)]
    out = log.sparkSession.createDataFrame(rows, "a int, b array<string>, line string")
    text = lambda name, labels, value: F.format_string(f"{prefix}_{name}{{{{{labels}}}}} %s".replace("{{", "{").replace("}}", "}"), *value)
    counts, ratios = request_counts(log), hit_ratio(log)
    out = out.union(part(counts, 1, [F.col("route"), F.col("status").cast("string")], text("requests_total", 'route="%s",status="%s"', ["route", "status", "requests"])))
    bucket = F.when(F.col("le") == "+Inf", "99999").otherwise(F.lpad("le", 5, "0"))
    out = out.union(part(latency_histogram(log), 3, [pos(ROUTES), bucket], text("request_duration_ms_bucket", 'route="%s",le="%s"', ["route", "le", "cumulative"])))
    totals = latency_totals(log)
    for k, (name, value) in enumerate((("sum", "sum_ms"), ("count", "requests"))):
        out = out.union(part(totals, 3, [pos(ROUTES), F.lit(f"99999{k}")], text(f"request_duration_ms_{name}", 'route="%s"', ["route", value])))
    for n, name, value in ((5, "cache_hits_total", F.col("hits")), (7, "cache_misses_total", F.col("misses")), (9, "cache_hit_ratio", F.format_string("%.6f", "ratio"))):
        out = out.union(part(ratios, n, [pos(CACHE_ROUTES)], text(name, 'route="%s"', ["route", value])))
    return out.select((F.row_number().over(Window.orderBy("a", "b")) - 1).alias("line_number"), "line")

"""Metrics from log events, in batch or as a stream. The same functions serve both: with ``window`` set, counts are per window.

For a stream, put ``withWatermark("ts", "10 minutes")`` on the events first: late events are then dropped and state is bounded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0, 30000.0]
# Argument names that a caller may not set.
UNSAFE = ["customer_id", "sql", "filters"]
OPS_PATHS = ["/health", "/ready", "/metrics"]
SCHEMA = "event string, ts timestamp, trace_id string, request_id string, endpoint string, method string, status int, latency_ms double, tool string, purpose string, timeout boolean, input_tokens long, output_tokens long, estimated_cost_usd double, empty boolean, llm_fallback_triggered boolean, llm_failure boolean, rating string"


def parse_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """Flat JSON log lines; what isn't JSON or has no event is left out."""
    return lines.select(F.from_json(col, SCHEMA).alias("e")).select("e.*").where("event is not null")


def cost_estimate(tokens_in: str = "input_tokens", tokens_out: str = "output_tokens", price_in: float = 0.15, price_out: float = 0.60) -> Column:
    """USD by prices per million tokens, rounded to 8 places; null without tokens."""
    some = F.col(tokens_in).isNotNull() | F.col(tokens_out).isNotNull()
    money = (F.coalesce(F.col(tokens_in), F.lit(0)).cast("decimal(20,0)") * F.lit(str(price_in)).cast("decimal(10,4)") + F.coalesce(F.col(tokens_out), F.lit(0)).cast("decimal(20,0)") * F.lit(str(price_out)).cast("decimal(10,4)")) / 1_000_000
    return F.when(some, F.round(money, 8).cast("double"))


def query_ref(col: str) -> Column:
    """What a log may say of a query: sixteen digits of its digest and its length."""
    return F.struct(F.substring(F.sha2(F.col(col), 256), 1, 16).alias("sha"), F.length(col).alias("chars"))


def redact_secrets(col: str) -> Column:
    return F.regexp_replace(col, r"(?i)(api[_-]?key|authorization|password|secret|token|database_url)(\s*[=:]\s*)\S+", "$1$2[REDACTED]")


def trace_id(col: str) -> Column:
    """The trace identifier of a W3C traceparent; null if it isn't one or is all zeros."""
    t = F.regexp_extract(F.lower(F.trim(col)), r"^[0-9a-f]{2}-([0-9a-f]{32})-[0-9a-f]{16}-[0-9a-f]{2}\z", 1)
    return F.when((t != "") & (t != "0" * 32), t)


def valid_id(col: Column, maximum: int = 128) -> Column:
    return F.when((F.length(col) > 0) & (F.length(col) <= maximum) & ~col.rlike(r"\s"), col)


def valid_customer(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^[A-Za-z0-9._-]{1,64}\z"), F.lit(False))


def short_id(col: Column, maximum: int = 64) -> Column:
    """The first ``maximum`` characters of an identifier without white space around it; empty where that is null or holds a quote,
    backslash, semicolon, line end or zero byte."""
    text = F.substring(F.trim(F.coalesce(col.cast("string"), F.lit(""))), 1, maximum)
    return F.when(text.rlike("[;'\"\\\\\n\r\x00]"), "").otherwise(text)


def safe_arguments(args: Column) -> Column:
    """A tool's arguments without the names that a caller may not set."""
    return F.map_filter(args, lambda k, _: ~F.lower(F.trim(k)).isin(*UNSAFE))


def enrich_events(events: DataFrame) -> DataFrame:
    """Adds the estimated cost."""
    return events.withColumn("estimated_cost_usd", F.when(F.col("event") == "llm_call", cost_estimate()))


def _grouped(events: DataFrame, window: str | None, *keys: str):
    return events.groupBy(*([F.window("ts", window)] if window else []), *keys)


def api_metrics(events: DataFrame, window: str | None = None) -> DataFrame:
    """Requests and errors by endpoint, method and status; operational paths are left out."""
    rows = events.where((F.col("event") == "request_completed") & ~F.col("endpoint").isin(*OPS_PATHS))
    return _grouped(rows, window, "endpoint", "method", "status").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))


def agent_metrics(events: DataFrame, window: str | None = None) -> DataFrame:
    """Completed agent runs, those with a latency, and its sum."""
    rows = events.where("event = 'agent_completed'")
    return _grouped(rows, window).agg(F.count("*").alias("runs"), F.count("latency_ms").alias("timed"), F.sum(F.col("latency_ms").cast("decimal(28,6)")).cast("double").alias("total_ms"))


def selection_errors(events: DataFrame, window: str | None = None) -> DataFrame:
    """Wrong choices of a tool, by tool."""
    rows = events.where("event = 'agent_tool_selection_error'").withColumn("tool", F.coalesce("tool", F.lit("unknown")))
    return _grouped(rows, window, "tool").agg(F.count("*").alias("errors"))


def tool_metrics(events: DataFrame, window: str | None = None) -> DataFrame:
    """Tool calls by tool and status."""
    rows = events.where("event = 'tool_execution'").withColumns({"tool": F.coalesce("tool", F.lit("unknown")), "status": F.coalesce(F.col("status").cast("string"), F.lit("unknown"))})
    return _grouped(rows, window, "tool", "status").agg(F.count("*").alias("calls"))


def llm_metrics(events: DataFrame, window: str | None = None) -> DataFrame:
    """Calls, failures, timeouts, tokens and cost by purpose and status; a status that isn't there is a success."""
    rows = enrich_events(events).where("event = 'llm_call'").withColumns({"purpose": F.coalesce("purpose", F.lit("unknown")), "failed": F.coalesce(F.col("status") >= 400, F.lit(False)), "status": F.coalesce(F.col("status").cast("string"), F.lit("success"))})
    return _grouped(rows, window, "purpose", "status").agg(
        F.count("*").alias("calls"),
        F.count_if("failed").alias("failures"),
        F.count_if("timeout").alias("timeouts"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("estimated_cost_usd").cast("decimal(20,8)")).cast("double").alias("cost_usd"),
    )


def search_metrics(events: DataFrame, window: str | None = None) -> DataFrame:
    rows = events.where("event = 'product_search_completed'")
    return _grouped(rows, window).agg(F.count("*").alias("searches"), F.count_if("empty").alias("empty_results"), F.count_if("llm_fallback_triggered").alias("fallbacks"), F.count_if("llm_failure").alias("fallback_failures"))


def rating_metrics(events: DataFrame, window: str | None = None) -> DataFrame:
    return _grouped(events.where("event = 'feedback_recorded'"), window, "rating").agg(F.count("*").alias("n"))


def latency_histogram(events: DataFrame, by: str = "event", value: str = "latency_ms", bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts of values up to each bound and without one, sum and count. Empty buckets are kept.

    One pass: a group's buckets are columns of one aggregate, unpivoted after it.
    """
    bounds = BOUNDS if bounds is None else bounds
    counts = events.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("n"), F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("total"))
    buckets = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative")))
    return counts.select(by, "n", "total", F.inline(buckets))


def metric_series(events: DataFrame) -> DataFrame:
    """All counters and histograms as (metric, labels, value); labels are pairs in order of name, in one text.

    One scan and one aggregate: an event adds to a few series, and is summed up with those of its series before anything is shuffled. A
    series that no event adds to isn't there.
    """
    pair = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    label = lambda **cs: F.array_join(F.array(*[pair(n, cs[n]) for n in sorted(cs)]), ",") if cs else F.lit("")
    amount, time = "decimal(28,8)", "decimal(28,6)"

    def counted(cond: Column, metric: str, labels: Column, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(metric).alias("metric"), labels.alias("labels"), value.cast(amount).alias("value"), F.lit(None).cast("double").alias("ms")))

    def timed(cond: Column, metric: str, labels: Column) -> Column:
        return F.when(cond, F.struct(F.lit(f"{metric}_latency_milliseconds").alias("metric"), labels.alias("labels"), F.lit(None).cast(amount).alias("value"), F.coalesce(F.col("latency_ms").cast("double"), F.lit(float("nan"))).alias("ms")))

    is_a = lambda name: F.col("event") == name
    request = is_a("request_completed") & ~F.col("endpoint").isin(*OPS_PATHS)
    agent, call, search = is_a("agent_completed"), is_a("llm_call"), is_a("product_search_completed")
    known = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    tool, purpose, one = known("tool", "unknown"), known("purpose", "unknown"), F.lit(1)
    failed, yes = F.coalesce(F.col("status") >= 400, F.lit(False)), lambda c: F.coalesce(F.col(c), F.lit(False))
    ends = {"endpoint": F.col("endpoint"), "status": F.col("status")}
    added = F.array(
        counted(request, "requests_total", label(**ends, method=F.col("method")), one),
        counted(request & failed, "errors_total", label(**ends), one),
        counted(agent, "agent_requests_total", label(), one),
        counted(is_a("agent_tool_selection_error"), "agent_tool_selection_errors_total", label(tool=tool), one),
        counted(is_a("tool_execution"), "tool_calls_total", label(tool=tool, status=known("status", "unknown")), one),
        counted(call, "llm_calls_total", label(purpose=purpose, status=known("status", "success")), one),
        counted(call & failed, "llm_failures_total", label(purpose=purpose), one),
        counted(call & yes("timeout"), "llm_timeouts_total", label(purpose=purpose), one),
        counted(call, "llm_tokens_total", F.lit("direction=input"), F.col("input_tokens")),
        counted(call, "llm_tokens_total", F.lit("direction=output"), F.col("output_tokens")),
        counted(call, "llm_estimated_cost_usd_total", label(), cost_estimate()),
        counted(search, "product_search_total", label(), one),
        *[counted(search, f"product_search_{name}_total", label(), yes(c).cast("int")) for name, c in (("empty", "empty"), ("llm_fallback", "llm_fallback_triggered"), ("llm_fallback_failures", "llm_failure"))],
        counted(is_a("feedback_recorded"), "feedback_total", label(rating=F.col("rating")), one),
        timed(request, "api_request", label(endpoint=F.col("endpoint"))),
        timed(agent, "agent", label()),
        timed(search, "product_search", label()),
        timed(call, "llm", label(purpose=purpose)),
    )
    rows = events.select(F.explode(F.array_compact(added)).alias("s")).select("s.metric", "s.labels", "s.value", "s.ms")
    is_time = F.col("ms").isNotNull()
    ms = F.when(~F.isnan("ms"), F.col("ms"))
    sums = rows.groupBy("metric", "labels").agg(F.max(is_time).alias("timed"), F.sum("value").alias("value"), F.count(ms).alias("n"), F.sum(ms.cast(time)).alias("total"), *[F.count_if(ms <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)])
    under = F.concat(F.when(F.col("labels") != "", F.concat("labels", F.lit(","))).otherwise(F.lit("")), F.lit("le="))
    line = lambda end, labels, value: F.struct(F.concat("metric", F.lit(end)).alias("metric"), labels.alias("labels"), value.cast("double").alias("value"))
    buckets = [line("_bucket", F.concat(under, F.lit(f"{b:g}")), F.col(f"b{i}")) for i, b in enumerate(BOUNDS)]
    histogram = F.array(line("_count", F.col("labels"), F.col("n")), line("_sum", F.col("labels"), F.col("total")), *buckets, line("_bucket", F.concat(under, F.lit("+Inf")), F.col("n")))
    return sums.select(F.inline(F.when(F.col("timed"), histogram).otherwise(F.array(line("", F.col("labels"), F.col("value"))))))


def _verdicts(times: list[float], held: deque, max_requests: int, window_s: float) -> list[bool]:
    """A sliding window of accepted events; denied ones don't count."""
    out = []
    for t in times:
        while held and held[0] <= t - window_s:
            held.popleft()
        out.append(len(held) < max_requests)
        if out[-1]:
            held.append(t)
    return out


def rate_limit_verdicts(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", max_requests: int = 20, window_s: float = 60.0) -> DataFrame:
    """Adds ``allowed``. Earlier verdicts decide later ones, so that a key's events are read in order.

    Rows are dealt by key and sorted inside their partitions, and a partition is read in batches: the state is one window of
    accepted times, never a key's events.
    """
    dealt = events.repartition(key).sortWithinPartitions(key, ts, order)
    schema = StructType([*dealt.schema.fields, StructField("allowed", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, deque()
        for batch in batches:
            allowed = []
            seconds = batch[ts].astype("int64") / 1e9 if str(batch[ts].dtype).endswith("[ns]") else batch[ts].astype("datetime64[us]").astype("int64") / 1e6
            for k, t in zip(batch[key], seconds, strict=True):
                if k != last:
                    last, held = k, deque()
                allowed += _verdicts([t], held, max_requests, window_s)
            yield batch.assign(allowed=allowed)

    return dealt.mapInPandas(run, schema)


def rate_limit_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", max_requests: int = 20, window_s: float = 60.0, expire: bool = True) -> DataFrame:
    """The limiter on a stream: the accepted times of one window are each key's state.

    With ``expire`` it is dropped when the window has passed; leave that off for runs that end with the available data, as
    they would wait for it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(ts)
        allowed = _verdicts((rows[ts].astype("datetime64[us]").astype("int64") / 1e6).tolist(), held, max_requests, window_s)
        state.update((list(held),))
        if expire:
            state.setTimeoutDuration(int(window_s * 1000))
        yield pd.DataFrame({key: [k[0]] * len(rows), ts: rows[ts].to_numpy(), "allowed": allowed})

    fields = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {fields[key]}, {ts} timestamp, allowed boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)

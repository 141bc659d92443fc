"""Traces of a stream by processing time, with bounded state.

Spans are dealt to shards by a hash of their trace. A shard keeps its open traces in state: of each the last spans, when it
was last seen, and its turn in the order of use. A trace that was quiet for the time to live is given out by a timer; where a
shard holds more traces than its share, the one that was used least recently is given out first. A span that comes after its
trace was given out starts a new, partial trace, so nothing is dropped for being late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Milliseconds a trace may be quiet, spans kept of a trace, and traces that are open at once.
TTL_MS, MAX_SPANS, MAX_TRACES = 30_000, 1000, 10_000
SPAN_FIELDS = (
    "timestamp", "ts_ms", "span_id", "parent_span_id", "service", "grouping", "cloud_region", "event_type", "operation", "target", "duration_us", "source", "response_size_bytes", "code",
    "instrumentation_scopes", "ord",
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_GIVEN = "trace_id string, reason string, last_seen_ms long, lost_spans long, spans array<string>"


class TraceWindow(StatefulProcessor):
    """The open traces of one shard."""

    def __init__(self, ttl_ms: int, max_spans: int, max_traces: int):
        self.ttl_ms, self.max_spans, self.max_traces = ttl_ms, max_spans, max_traces

    def init(self, handle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "trace_id string", "spans array<string>")
        # apart from the spans: looking for the least recent trace or for quiet ones reads no spans
        self.used = handle.getMapState("used", "trace_id string", "seen long, turn long, lost long")
        self.turn = handle.getValueState("turn", "turn long, traces long")

    def _give(self, found: list[tuple[str, str]]) -> Iterator:
        import pandas as pd

        rows = []
        for trace, reason in found:
            seen, _, lost = self.used.getValue((trace,))
            rows.append((trace, reason, seen, lost, list(self.spans.getValue((trace,))[0])))
            self.spans.removeKey((trace,))
            self.used.removeKey((trace,))
        if rows:
            yield pd.DataFrame(rows, columns=["trace_id", "reason", "last_seen_ms", "lost_spans", "spans"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        now = timerValues.getCurrentProcessingTimeInMs()
        turn, open_ = self.turn.get() if self.turn.exists() else (0, 0)
        for batch in rows:
            batch = batch.sort_values(["ord", "span_id"], kind="stable", na_position="first")
            # least recently used first: traces in the order of their last span in the batch
            last = batch.groupby("trace_id", sort=False)["span"].agg(list)
            order = batch["trace_id"].drop_duplicates(keep="last")
            for trace in order:
                new, known = last[trace], self.used.containsKey((trace,))
                held = list(self.spans.getValue((trace,))[0]) if known else []
                lost = self.used.getValue((trace,))[2] if known else 0
                held += new
                turn += 1
                self.spans.updateValue((trace,), (held[-self.max_spans :],))
                self.used.updateValue((trace,), (now, turn, lost + max(0, len(held) - self.max_spans)))
                open_ += not known
            if open_ > self.max_traces:
                by_turn = sorted((used[1], trace[0]) for trace, used in self.used.iterator())
                over = [(trace, "evicted") for _, trace in by_turn[: open_ - self.max_traces]]
                open_ -= len(over)
                yield from self._give(over)
        self.turn.update((turn, open_))
        self.handle.registerTimer(now + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = timerValues.getCurrentProcessingTimeInMs()
        quiet = sorted(trace[0] for trace, used in self.used.iterator() if now - used[0] > self.ttl_ms)
        turn, open_ = self.turn.get()
        self.turn.update((turn, open_ - len(quiet)))
        yield from self._give([(trace, "expired") for trace in quiet])

    def close(self) -> None:
        pass


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Custom state needs this store; it holds for streams that are started afterwards."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def assemble_traces(stream: DataFrame, ttl_ms: int = TTL_MS, max_spans: int = MAX_SPANS, max_traces: int = MAX_TRACES, shards: int | None = None) -> DataFrame:
    """trace_id, reason (expired or evicted), last_seen_ms, lost_spans and spans (the last ``max_spans``) of each trace.

    A trace is given out when no span of it came for ``ttl_ms`` of processing time, or earlier where its shard holds more than
    its share of ``max_traces``. Spans of one micro-batch are taken in the order of ``ord``. Spans without a trace id are left
    out. Restarts go on from the checkpoint; the state never holds more than max_traces times max_spans spans.
    """
    keep_state_in_rocksdb(stream.sparkSession)
    shards = min(shards or int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")), max_traces)
    processor = TraceWindow(ttl_ms, max_spans, -(-max_traces // shards))
    span = F.struct(*SPAN_FIELDS)
    rows = stream.filter("trace_id is not null").select(F.pmod(F.xxhash64("trace_id"), F.lit(shards)).alias("shard"), "trace_id", "ord", "span_id", F.to_json(span).alias("span"))
    given = rows.groupBy("shard").transformWithStateInPandas(processor, _GIVEN, "append", "ProcessingTime")
    schema = stream.select(span.alias("span")).schema["span"].dataType
    spans = F.transform("spans", lambda s: F.from_json(s, schema))
    return given.select("trace_id", "reason", "last_seen_ms", "lost_spans", spans.alias("spans"))


def trace_spans(traces: DataFrame) -> DataFrame:
    """The spans of assembled traces as rows."""
    return traces.select("trace_id", F.explode("spans").alias("s")).select("trace_id", "s.*")

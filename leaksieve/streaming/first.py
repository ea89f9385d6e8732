"""The earliest finding of each id in a stream whose rows come in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The state store that keeps timers; set before the query starts.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ORDER, _MOMENT = "_order", "_moment"


class _Earliest(StatefulProcessor):
    """One row of state for each id that is waited for: its earliest finding in scan order, and until when it waits."""

    def __init__(self, columns: list[str], schema: str, delay_ms: int):
        self.columns, self.schema, self.delay_ms = columns, schema, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"{self.schema}, _until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get() if self.kept.exists() else None
        for frame in rows:
            # by place: Spark renames what begins with an underscore on the way
            order, moment = frame.columns[-2:]
            for row in frame.sort_values([moment, order]).itertuples(index=False, name=None):
                moment = int(row[-1])
                if kept is not None and moment > kept[-1]:
                    # later than the delay: the id is reported anew
                    self.handle.deleteTimer(kept[-1])
                    yield self._frame(kept)
                    kept = None
                if kept is None:
                    kept = (*row, moment + self.delay_ms)
                    self.handle.registerTimer(kept[-1])
                elif row[-2] < kept[-3]:
                    kept = (*row, kept[-1])
        self.kept.update(tuple(None if x is pd.NaT or x != x else x for x in kept))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            kept = self.kept.get()
            self.kept.clear()
            yield self._frame(kept)

    def _frame(self, kept: tuple) -> pd.DataFrame:
        return pd.DataFrame([kept[: len(self.columns)]], columns=self.columns)

    def close(self) -> None:
        pass


def stream_earliest(findings: DataFrame, delay: str, ts: str = "ts", seq: str = "seq", watermark: bool = True) -> DataFrame:
    """The first finding of each id in scan order, of all that come within the delay, in whatever order they come.

    A finding waits ``delay`` of event time, from the first one of its id, and is then reported and forgotten: state is one
    row for each id of that time, its end a timer. What comes later than that, but not too late for the watermark, is a new
    report. Needs the state store :data:`ROCKS` under :data:`STORE`. As ``dedup_findings``, without ``seq``.

    Without ``watermark`` the stream brings its own: on the texts, say, so that time goes on where nothing is found.
    """
    spark = findings.sparkSession
    if spark.conf.get(STORE, "") != ROCKS:
        raise RuntimeError(f"set {STORE} to {ROCKS}")
    columns = [c for c in findings.columns if c != seq]
    milliseconds = spark.range(1).select((F.expr(f"cast(timestamp'1970-01-01' + interval {delay} as double)") - F.expr("cast(timestamp'1970-01-01' as double)"))).first()[0]
    # the scan order as a text that sorts alike: platform and ticket, then the numbers of field and item
    parts = [F.coalesce(F.col(f"{seq}.{c}").cast("string"), F.lit("")) for c in ("platform", "issue_id")]
    parts += [F.lpad(F.coalesce(F.col(f"{seq}.{c}"), F.lit(0)).cast("string"), 20, "0") for c in ("field_ord", "item_ord")]
    timed = findings.withWatermark(ts, delay) if watermark else findings
    ready = timed.select(
        *columns, F.concat_ws("\x01", *parts).alias(_ORDER), F.unix_millis(ts).alias(_MOMENT)
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.select(*columns).schema)
    processor = _Earliest(columns, f"{schema}, {_ORDER} string, {_MOMENT} bigint", int(milliseconds * 1000))
    return ready.groupBy("id").transformWithStateInPandas(processor, schema, "Append", "EventTime")

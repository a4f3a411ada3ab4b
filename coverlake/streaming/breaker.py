"""The circuit breaker as a stream with timers: a date on which an endpoint is due again passes without any attempt on it.

State is kept for failing outlets only; a success ends it. Each failing outlet has a timer at its date, and one from which it is
forgotten. Timers go by the watermark, so a replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import failure_kind
from ..operators.folds import DAY, as_time, next_state

STATE = "status string, reason string, failures long, until long, since long, last long"
OUT = f"outlet_id string, event string, {STATE}"
WELL = ("active", None, 0, None, None)
COLUMNS = ["at", "id", "ok", "kind", "reason", "duplicate"]


class Breaker(StatefulProcessor):
    def __init__(self, forget_days: int):
        self.forget = forget_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", STATE)

    def close(self) -> None:
        pass

    def told(self, key: tuple, event: str, state: tuple, last: int) -> pd.DataFrame:
        out = pd.DataFrame(
            [(key[0], event, *state, last)], columns=["outlet_id", "event", "status", "reason", "failures", "until", "since", "last"]
        )
        return out.astype({"until": "Int64", "since": "Int64", "last": "Int64", "failures": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else (*WELL, None)
        # an outlet's attempts of a batch are ordered as numbers; of those before its last success nothing counts
        parts, bound = [], None
        for part in rows:
            own = part[COLUMNS]
            good = own[own["ok"]]
            if len(good):
                last = max(zip(good["at"].tolist(), good["id"].tolist(), strict=True))
                bound = last if bound is None else max(bound, last)
            parts.append(own)
            if bound is not None:
                parts = [p[(p["at"] > bound[0]) | (p["at"] == bound[0]) & (p["id"] >= bound[1])] for p in parts]
        state, at = now[:5], now[5]
        for r in pd.concat(parts).sort_values(["at", "id"]).itertuples():
            state, at = next_state(state, int(r.at), bool(r.ok), r.kind, r.reason, bool(r.duplicate)), int(r.at)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state == WELL:
            self.state.clear()
        else:
            self.state.update((*state, at))
            for t in {x // 1000 for x in (state[3], at + self.forget) if x is not None}:
                self.handle.registerTimer(t)
        yield self.told(key, "attempt", state, at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        *state, last = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at >= (last + self.forget) // 1000:
            self.state.clear()
            yield self.told(key, "forgotten", WELL, last)
        elif state[3] is not None and at >= state[3] // 1000:
            yield self.told(key, "due", tuple(state), last)


def breaker(attempts: DataFrame, delay: str = "0 seconds", forget_days: int = 90) -> DataFrame:
    """attempts: outlet_id, ran_at (timestamp), id, attempted, ok, status_code, error and perhaps duplicate. After each batch a
    row for each outlet in it (event ``attempt``), for each whose date has passed (``due``) and for each given up (``forgotten``).

    Needs the state store that has timers (spark.sql.streaming.stateStore.providerClass: RocksDBStateStoreProvider).
    """
    duplicate = F.col("duplicate") if "duplicate" in attempts.columns else F.lit(False)
    failure = failure_kind(F.col("status_code"), F.col("error"))
    rows = attempts.filter("attempted").withWatermark("ran_at", delay).select(
        "outlet_id", "ran_at", F.unix_micros("ran_at").alias("at"), "id", "ok", failure["kind"].alias("kind"), failure["reason"].alias("reason"), F.coalesce(duplicate, F.lit(False)).alias("duplicate")
    )
    out = rows.groupBy("outlet_id").transformWithStateInPandas(Breaker(forget_days), OUT, "Update", "EventTime")
    return out.select(
        "outlet_id", "event", "status", "reason", "failures", as_time(F.col("until")).alias("disabled_until"),
        as_time(F.col("since")).alias("disabled_since"), as_time(F.col("last")).alias("last_attempted_at")
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
__all__ = ["ROCKSDB", "breaker"]

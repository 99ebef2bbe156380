"""Keyed state that outlives batches: reducers of a session's updates, and what was used last.

Both run on streams and, by the same code, on tables. A stream needs the state store that keeps more than one kind of
state (``spark.sql.streaming.stateStore.providerClass`` = ``...state.RocksDBStateStoreProvider``). A key's rows of one batch are
put in order in its task; what stays between batches is a value a reducer, a capped list and a map.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Reducers(StatefulProcessor):
    """States: one value (the overwritten and the first columns, the place reached, whether it stopped), a list, a map."""

    def __init__(self, key: str, last: list[str], first: list[str], append: str | None, merge: tuple[str, str] | None, stop: str | None, cap: int | None, types: dict[str, str], ttl: int | None, names: list[str]):
        self.names = names
        self.key, self.last, self.first, self.append, self.merge, self.stop, self.cap, self.types, self.ttl = key, last, first, append, merge, stop, cap, types, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        of = ", ".join(f"`{c}` {self.types[c]}" for c in (*self.last, *self.first))
        self.values = handle.getValueState("values", f"{of}{', ' if of else ''}`_stopped` boolean", self.ttl)
        self.log = handle.getListState("log", f"item {self.types[self.append]}", self.ttl) if self.append else None
        self.map = handle.getMapState("map", f"field {self.types[self.merge[0]]}", f"value {self.types[self.merge[1]]}", self.ttl) if self.merge else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.values.get() if self.values.exists() else None
        names = (*self.last, *self.first)
        now = dict(zip(names, held)) if held else dict.fromkeys(names)
        stopped = bool(held[-1]) if held else False
        # Computed columns come without their names, in their places.
        batch = pd.concat([d.set_axis(self.names, axis=1) for d in rows]).sort_values("_order", kind="stable")
        if self.stop and len(batch):
            over = batch[self.stop].fillna(False).astype(bool).cumsum() > 0
            batch, ends = batch[~over], bool(over.any())
        else:
            ends = False
        if not stopped and len(batch):
            for c in self.last:
                seen = batch[c].dropna()
                now[c] = seen.iloc[-1] if len(seen) else now[c]
            for c in self.first:
                seen = batch[c].dropna()
                now[c] = seen.iloc[0] if now[c] is None and len(seen) else now[c]
            if self.log is not None:
                items = [(x,) for x in batch[self.append].dropna().tolist()]
                kept = [*self.log.get(), *items]
                self.log.put(kept[-self.cap :] if self.cap else kept) if kept else None
            if self.map is not None:
                f, v = self.merge
                for field, value in zip(batch[f].tolist(), batch[v].tolist()):
                    if field is not None and field == field:
                        self.map.updateValue((field,), (value,))
        plain = lambda x: x.item() if hasattr(x, "item") else x
        self.values.update((*(plain(now[c]) for c in names), stopped or ends))
        out = {self.key: [key[0]], **{c: [plain(now[c])] for c in names}, "stopped": [stopped or ends]}
        if self.log is not None:
            out["items"] = [[x[0] for x in self.log.get()]]
        if self.map is not None:
            out["fields"] = [[{"field": k[0], "value": v[0]} for k, v in sorted(self.map.iterator())]]
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _ready(rows: DataFrame) -> DataFrame:
    """Start what state stores report to; on tables nothing else does."""
    _ = rows.sparkSession.streams.active
    return rows


def reduced(
    rows: DataFrame, key: str, order: str, last: tuple[str, ...] = (), first: tuple[str, ...] = (), append: str | None = None, merge: tuple[str, str] | None = None, stop: str | None = None, cap: int | None = None, ttl: int | None = None,
) -> DataFrame:
    """(key, last.., first.., stopped, items, fields) after the rows so far, by each key's order.

    ``last`` columns are overwritten by what is not null, ``first`` columns keep their first value, ``append`` gathers items
    (the last ``cap`` of them), ``merge`` = (field, value) is a map that later values overwrite field by field. From the
    first row on whose ``stop`` is true, nothing more is taken in. ``ttl`` in milliseconds lets state of idle keys expire."""
    used = [c for c in dict.fromkeys([*last, *first, *([append] if append else []), *(merge or ()), *([stop] if stop else [])])]
    types, d = dict(rows.dtypes), _ready(rows).select(F.col(key).alias(key), F.col(order).alias("_order"), *[c for c in used if c != key])
    out = T.StructType([rows.schema[key], *[T.StructField(c, rows.schema[c].dataType) for c in (*last, *first)], T.StructField("stopped", T.BooleanType())])
    if append:
        out.add("items", T.ArrayType(rows.schema[append].dataType))
    if merge:
        out.add("fields", T.ArrayType(T.StructType([T.StructField(n, rows.schema[c].dataType) for n, c in zip(("field", "value"), merge)])))
    processor = _Reducers(key, list(last), list(first), append, merge, stop, cap, types, ttl, d.columns)
    return d.groupBy(key).transformWithStateInPandas(processor, out, "Update", "ProcessingTime" if ttl else "None")


class _Recent(StatefulProcessor):
    """A map from item to when it was used last, held to the newest ``most`` and to ``age`` before the newest."""

    def __init__(self, key: str, item: str, most: int, age: int | None, kind: str, wait: int | None):
        self.key, self.item, self.most, self.age, self.kind, self.wait = key, item, most, age, kind, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.used = handle, handle.getMapState("used", f"item {self.kind}", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        used = {k[0]: v[0] for k, v in self.used.iterator()}
        before = set(used)
        for d in rows:
            for item, at in zip(d.iloc[:, 1].tolist(), d.iloc[:, 2].tolist()):
                if item is not None and (item not in used or at > used[item]):
                    used[item] = at
                    if len(used) > 2 * self.most:  # more than that is never held, however many rows a batch has
                        used = self._kept(used)
        used = self._kept(used)
        for item in before - set(used):
            self.used.removeKey((item,))
        for item, at in used.items():
            self.used.updateValue((item,), (int(at),))
        if self.wait is not None:  # an idle key is forgotten as a whole
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield self._rows(key, used)

    def _kept(self, used: dict) -> dict:
        newest = max(used.values(), default=0)
        order = sorted(used.items(), key=lambda x: (-x[1], x[0]))[: self.most]
        return {k: at for k, at in order if self.age is None or at >= newest - self.age}

    def _rows(self, key: Any, used: dict) -> pd.DataFrame:
        order = sorted(used.items(), key=lambda x: (-x[1], x[0]))
        return pd.DataFrame({self.key: [key[0]] * len(order), self.item: [k for k, _ in order], "at": [v for _, v in order], "place": range(1, len(order) + 1)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.used.clear()
        yield self._rows(key, {})

    def close(self) -> None:
        pass


def recently_used(rows: DataFrame, key: str, item: str, at: str, most: int, age: int | None = None, wait: int | None = None) -> DataFrame:
    """(key, item, at, place): of each key that a batch brings the ``most`` items used last, none older than ``age`` before
    the newest (in the unit of ``at``, a whole number); ``wait`` milliseconds without rows and a key's state goes."""
    d = _ready(rows).select(key, item, F.col(at).cast("long").alias("_at"))
    out = T.StructType([rows.schema[key], rows.schema[item], T.StructField("at", T.LongType()), T.StructField("place", T.LongType())])
    return d.groupBy(key).transformWithStateInPandas(_Recent(key, item, most, age, dict(rows.dtypes)[item], wait), out, "Update", "ProcessingTime" if wait else "None")

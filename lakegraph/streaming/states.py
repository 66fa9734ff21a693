"""Keyed state with time to live: results that never shrink, patches that come late, changes between snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream of this module needs when it is started: a store for several states a key, and no batches without data,
#: which time to live would ask for without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: A key's state goes when nothing has come for so long.
TIME_TO_LIVE_MS = 30 * 24 * 3600 * 1000


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """Start streams of this module inside; the session's settings are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, mode, "ProcessingTime")


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order."""
    return pd.concat(rows, ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class _Newest(StatefulProcessor):
    """For each key the first order that it came with, the newest row and how many rows came."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "first long, newest long, seen long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        orders = _sorted(rows, ["n"])["n"]
        first, newest, seen = self.shown.get() if self.shown.exists() else (int(orders.iloc[0]), int(orders.iloc[0]), 0)
        state = (min(first, int(orders.iloc[0])), max(newest, int(orders.iloc[-1])), seen + len(orders))
        self.shown.update(state)
        yield pd.DataFrame({"key": [key[0]], "first": [state[0]], "newest": [state[1]], "seen": [state[2]]})

    def close(self) -> None:
        pass


def monotone_results(stream: DataFrame, ttl: int = TIME_TO_LIVE_MS) -> DataFrame:
    """Updates ``key, first, newest, seen`` from ``key string, n long``: a key that was shown stays and shows its newest row.

    Upserted by key and cut by ``first``, the list never shrinks: ``first`` never grows, so that a shown key keeps its place.
    """
    return _stateful(stream.select("key", "n"), "key", _Newest(ttl), "key string, first long, newest long, seen long", "Update")


class _Patched(StatefulProcessor):
    """Holds a lead and the distinct signals that came for it, before it or after."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lead = handle.getValueState("lead", "name string", self.ttl)
        self.signals = handle.getMapState("signals", "kind string, title string", "confidence long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed = False
        for r in _sorted(rows, ["at", "kind", "title", "confidence"]).itertuples():
            if r.is_lead:
                changed = changed or not self.lead.exists() or self.lead.get()[0] != r.name
                self.lead.update((r.name,))
            else:
                known = (r.kind or "", r.title or "")
                if not self.signals.containsKey(known):
                    self.signals.updateValue(known, (int(r.confidence),))
                    changed = True
        if changed and self.lead.exists():
            values = [v[0] for v in self.signals.values()]
            yield pd.DataFrame({"id": [key[0]], "name": [self.lead.get()[0]], "n_signals": [len(values)], "confidence": [max(values, default=0)]})

    def close(self) -> None:
        pass


def late_patches(stream: DataFrame, ttl: int = TIME_TO_LIVE_MS) -> DataFrame:
    """Updates ``id, name, n_signals, confidence`` of leads from ``id string, is_lead boolean, at long, name, kind, title string, confidence long``.

    A signal with a type and title that the lead has is no change; signals that come before their lead wait for it.
    """
    columns = stream.select("id", "is_lead", "at", "name", "kind", "title", "confidence")
    return _stateful(columns, "id", _Patched(ttl), "id string, name string, n_signals long, confidence long", "Update")


class _Changes(StatefulProcessor):
    """Holds an entity's last snapshot."""

    def __init__(self, flags: list[str], ttl: int):
        self.flags, self.ttl = flags, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = [f"{f} boolean" for f in self.flags]
        self.last = handle.getValueState("last", ", ".join([*columns, "rating double"]), self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        found = []
        for r in _sorted(rows, ["at", "id"]).to_dict("records"):
            rating = None if pd.isna(r["rating"]) else float(r["rating"])
            now = (*(bool(r[f]) for f in self.flags), rating)
            if before is not None:
                found += [(r["id"], f + ("+" if b else "-")) for f, a, b in zip(self.flags, before, now) if a != b]
                if None not in (before[-1], rating) and abs(rating - before[-1]) >= 0.3 - 1e-9:
                    found.append((r["id"], "rating+" if rating > before[-1] else "rating-"))
                if "site" in self.flags and before[self.flags.index("site")] != now[self.flags.index("site")]:
                    found.append((r["id"], "website_status" + ("+" if now[self.flags.index("site")] else "-")))
            before = now
        self.last.update(before)
        if found:
            yield pd.DataFrame(found, columns=["id", "change"])

    def close(self) -> None:
        pass


def snapshot_changes(stream: DataFrame, flags: list[str], ttl: int = TIME_TO_LIVE_MS) -> DataFrame:
    """``id, change`` of snapshots ``id long, entity long, at timestamp, rating double`` and boolean ``flags``, against the entity's last one.

    Snapshots of one micro-batch are taken in the order of their time; one that comes in a later batch is later. A null
    flag is false, a null rating is compared with nothing.
    """
    columns = stream.select("id", "entity", "at", *flags, "rating")
    return _stateful(columns, "entity", _Changes(flags, ttl), "id long, change string", "Append")

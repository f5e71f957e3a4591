"""What the streams keep per key in Spark's state store, and how rows are thinned out before they get there."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Executors get the code with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def record_highs(rows: DataFrame) -> DataFrame:
    """Rows (key, ord, seq) without those that an earlier one of their own Arrow batch already outdoes.

    What is left of a busy key is little more than what it will give in the end, so its task stays small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = batch.to_pandas().sort_values("ord", kind="stable")
            top = df.groupby("key", dropna=False)["seq"].cummax()
            yield pa.RecordBatch.from_pandas(df[df["seq"] == top], schema=batch.schema, preserve_index=False)

    return rows.mapInArrow(run, rows.schema)


class NewestRequest(StatefulProcessor):
    """Keeps the newest request seen per key; passes responses on that no newer request was seen before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True).sort_values("ord", kind="stable")
        held = self.top.get()
        seen = np.maximum.accumulate(np.append(held[0] if held else np.iinfo(np.int64).min, df["seq"].to_numpy()))
        self.top.update((int(seen[-1]),))
        yield df[df["seq"].to_numpy() == seen[1:]]

    def close(self) -> None:
        pass


BURST = "name long, first timestamp, last timestamp, seq long, n_writes long"


NONE = np.iinfo(np.int64).min  # stands for a null, as in numpy's times
CHUNK = 4096  # bursts that share one entry of the state


def merge_bursts(rows: np.ndarray, quiet: int) -> np.ndarray:
    """Bursts (first, last, seq, n_writes in columns, times in microseconds) of one name, joined where the next begins
    within ``quiet`` of the last write. Rows without a time join the last burst."""
    first, last = rows[:, 0], rows[:, 1]
    rows = rows[np.lexsort([last, first, first == NONE])]
    first, last, seq = rows[:, 0], rows[:, 1], rows[:, 2]
    new = np.ones(len(rows), bool)
    new[1:] = (first[1:] != NONE) & (first[1:] - np.maximum.accumulate(last)[:-1] > quiet)
    at, number = np.flatnonzero(new), np.cumsum(new)
    # Of the last write that has a number; rows without a time come last.
    order = np.lexsort([seq, last, last == NONE, seq != NONE, number])
    newest = seq[order[np.append(at[1:], len(rows)) - 1]]
    return np.stack([first[at], np.maximum.reduceat(last, at), newest, np.add.reduceat(rows[:, 3], at)], 1)


def partial_bursts(events: DataFrame, quiet: str) -> DataFrame:
    """Writes (name, ts, seq) as bursts within each Arrow batch: a busy name sends few rows to its state."""
    gap = pd.Timedelta(quiet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = batch.to_pandas().rename(columns={"ts": "first"}).assign(n_writes=1).sort_values(["name", "first", "seq"], ignore_index=True)
            df["last"] = df["first"]
            new = (df["first"].diff() > gap) | (df["name"] != df["name"].shift())
            grouped = df.groupby(new.cumsum())
            out = grouped.agg(name=("name", "first"), first=("first", "min"), last=("last", "max"), seq=("seq", "last"), n_writes=("n_writes", "sum"))
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    zone = pa.timestamp("us", tz="UTC")
    schema = pa.schema([("name", pa.int64()), ("first", zone), ("last", zone), ("seq", pa.int64()), ("n_writes", pa.int64())])
    return events.select("name", "ts", "seq").mapInArrow(run, BURST)


class Bursts(StatefulProcessor):
    """Open bursts per name. Each change is passed on as the burst's new form; one that another has swallowed comes
    with no writes. Bursts are kept as chunks of numbers, and one event-time timer per name, at the end of its earliest
    burst, forgets all bursts that no write can join any more."""

    def __init__(self, quiet: str) -> None:
        self.quiet = pd.Timedelta(quiet).value // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "bursts binary")

    def _held(self) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(r[0]) for r in self.open.get()), np.int64).reshape(-1, 4)

    def _hold(self, rows: np.ndarray) -> None:
        if len(rows):
            self.open.put([(rows[i : i + CHUNK].tobytes(),) for i in range(0, len(rows), CHUNK)])
        else:
            self.open.clear()

    def _wake(self, rows: np.ndarray) -> None:
        self.handle.registerTimer((int(rows[:, 1].min()) + self.quiet) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, new = self._held(), [_numbers(df) for df in rows]
        merged = merge_bursts(np.concatenate([held, *new]), self.quiet)
        timed = merged[merged[:, 1] != NONE]
        self._hold(timed)
        if len(timed) and not (len(held) and held[:, 1].min() <= timed[:, 1].min()):
            self._wake(timed)
        changed = merged
        if len(held):
            # Bursts do not overlap, so the first write names a burst.
            at = np.searchsorted(held[:, 0], merged[:, 0]).clip(max=len(held) - 1)
            gone = held[~np.isin(held[:, 0], merged[:, 0])]
            changed = np.concatenate([merged[(held[at] != merged).any(1)], gone * [1, 1, 1, 0]])
        yield _frame(key[0], changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        kept = held[held[:, 1] + self.quiet >= timerValues.getCurrentWatermarkInMs() * 1000]
        if len(kept) < len(held):
            self._hold(kept)
        if len(kept):
            self._wake(kept)
        yield from ()

    def close(self) -> None:
        pass


def _numbers(df: pd.DataFrame) -> np.ndarray:
    """Bursts as rows of four integers; times in microseconds."""
    times = [pd.to_datetime(df[c], utc=True).astype("datetime64[us, UTC]").astype("int64") for c in ("first", "last")]
    seq = df["seq"].to_numpy() if df["seq"].dtype == np.int64 else df["seq"].astype("Int64").to_numpy(np.int64, na_value=NONE)
    return np.stack([*(t.to_numpy() for t in times), seq, df["n_writes"].to_numpy()], 1)


def _frame(name, rows: np.ndarray) -> pd.DataFrame:
    seq = rows[:, 2]
    known = pd.Series(seq) if (seq != NONE).all() else pd.Series(seq).astype("Int64").mask(seq == NONE)
    times = {c: rows[:, i].astype("datetime64[us]") for i, c in enumerate(("first", "last"))}
    return pd.DataFrame({"name": name, **times, "seq": known, "n_writes": rows[:, 3]})

"""A conversation's log whose history is fetched while live messages already come in.

"open" registers a conversation and asks for its history.  Until the history is there,
live messages wait in state, each key once.  "fetched" ends it: the history without what
waits is appended, oldest first, then what waits in the order of its arrival.
"failed" drops what came of that history and keeps the waiting messages; the fetch is
asked for again by the next live message, or by a timer.  A conversation that was never
opened, or that comes from a stored log, is ready at once.

"cursor" captures the boundary before the next live message.  It is resolved when the
history is in, because the numbers of the waiting messages are not known before.

A log holds ``capacity`` keys and drops older ones after each append, so the rows do not
depend on how the events are cut into micro-batches.  Beside those keys the state holds what
came during one fetch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engramlake.schema import LOG_CAPACITY

COLUMNS = ["conversation_id", "kind", "message_key", "ts", "role", "seq"]
OUTPUT = "conversation_id string, kind string, message_key string, ts long, role string, seq long"
MESSAGE = "message_key string, ts long, role string"


class _Log:
    """The held keys with their numbers, the next number and the clearing time."""

    def __init__(self, held: dict, seq: int, cleared: int | None, capacity: int):
        self.held, self.seq, self.cleared, self.capacity = held, seq, cleared, capacity

    def append(self, messages: list[tuple]) -> list[tuple]:
        """The messages that are new and later than the clearing, with their numbers."""
        out = []
        for key, ts, role in messages:
            if key in self.held or self.cleared is not None and ts is not None and ts <= self.cleared:
                continue
            self.held[key] = self.seq
            out.append((key, ts, role, self.seq))
            self.seq += 1
        for key in list(self.held)[: max(0, len(self.held) - self.capacity)]:
            del self.held[key]
        return out

    def tail(self) -> int | None:
        return next(reversed(self.held.values()), None)

    def boundary(self, history_end: int, waited: int) -> int:
        """The number after which the next live message of a cursor lies, of whose predecessors so many waited."""
        oldest = next((s for s in self.held.values() if s > history_end), None)
        return history_end + waited if oldest is None else max(history_end + waited, oldest - 1)


class BackfilledLog(StatefulProcessor):
    """Input: conversation_id, kind ("open", "live", "history", "fetched", "failed", "cursor", "clear"), message_key (of a cursor: its name), ts (ms), role, order (arrival)."""

    def __init__(self, capacity: int, retry_ms: int | None):
        self.capacity, self.retry_ms = capacity, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "message_key string, seq long")
        self.waiting = handle.getListState("waiting", MESSAGE)
        self.history = handle.getListState("history", MESSAGE)
        self.cursors = handle.getListState("cursors", "name string, waited long")
        self.state = handle.getValueState("state", "cold boolean, idle boolean, next_seq long, history_end long, cleared_at long")

    def _keep(self, state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def handleInitialState(self, key, stored: pd.DataFrame, timers) -> None:
        """stored: message_key, seq of a log that was kept; may come in several parts."""
        held = dict(self.held.get()) if self.held.exists() else {}
        held.update(zip(stored["message_key"], stored["seq"].astype(int).tolist()))
        held = dict(sorted(held.items(), key=lambda x: x[1]))
        top = max(held.values(), default=0)
        self._keep(self.held, list(held.items())[-self.capacity :])
        self.state.update((False, False, top + 1, top, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        cold, idle, seq, history_end, cleared = self.state.get() if known else (False, False, 1, 0, None)
        log = _Log(dict(tuple(x) for x in self.held.get()) if self.held.exists() else {}, seq, cleared, self.capacity)
        waiting = {x[0]: tuple(x) for x in self.waiting.get()} if cold and self.waiting.exists() else {}
        history = [tuple(x) for x in self.history.get()] if cold and self.history.exists() else []
        cursors = [tuple(x) for x in self.cursors.get()] if cold and self.cursors.exists() else []
        out = []

        def ask():
            out.append((key[0], "fetch", None, None, None, None))

        def accepted(messages):
            out.extend((key[0], "message", *m) for m in log.append(messages))

        batch = pd.concat(list(rows)).sort_values("order", kind="stable")
        for kind, name, ts, role in zip(batch["kind"], batch["message_key"], batch["ts"], batch["role"]):
            message = (name, None if pd.isna(ts) else int(ts), role)
            if kind == "open" and not known:
                cold = True
                ask()
            elif kind == "live" and cold:
                waiting.setdefault(name, message)
                if idle:
                    idle = False
                    ask()
            elif kind == "live":
                accepted([message])
            elif kind == "cursor" and cold:
                cursors.append((name, len(waiting)))
            elif kind == "cursor":
                out.append((key[0], "cursor", name, None, None, log.tail() or history_end))
            elif kind == "clear":
                history_end = log.tail() or history_end
                log.held, log.cleared, waiting = {}, message[1], {}
                cursors = [(c, 0) for c, _ in cursors]
            elif kind == "history" and cold:
                history.append(message)
            elif kind == "failed" and cold:
                history, idle = [], True
                if self.retry_ms is not None:
                    self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.retry_ms)
            elif kind == "fetched" and cold:
                accepted(sorted((m for m in history if m[0] not in waiting and m[1] is not None), key=lambda m: (m[1], m[0])))
                history_end = log.tail() or history_end
                accepted(list(waiting.values()))
                out.extend((key[0], "cursor", c, None, None, log.boundary(history_end, n)) for c, n in cursors)
                cold, idle, waiting, history, cursors = False, False, {}, [], []
            known = True
        self._keep(self.held, list(log.held.items()))
        self._keep(self.waiting, list(waiting.values()))
        self._keep(self.history, history)
        self._keep(self.cursors, cursors)
        self.state.update((cold, idle, log.seq, history_end, log.cleared))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cold, idle, *rest = self.state.get()
        if cold and idle:
            self.state.update((cold, False, *rest))
            yield _frame([(key[0], "fetch", None, None, None, None)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS)
    return frame.astype({"ts": "Int64", "seq": "Int64"})


def backfilled(events: DataFrame, history: DataFrame | None = None, *, stored: DataFrame | None = None, capacity: int = LOG_CAPACITY, retry_ms: int | None = None) -> DataFrame:
    """(conversation_id, kind, message_key, ts, role, seq) of a stream or a table: accepted messages, resolved cursors and fetches asked for.

    history: a second input of the same columns, whose rows and ends of fetches come by a way of their own.
    stored (conversation_id, message_key, seq): logs kept earlier, from which a stream starts.
    retry_ms: a failed fetch is asked for again after so long, on streams only; such a stream runs until it is stopped.
    """
    both = events if history is None else events.unionByName(history)
    streaming = both.isStreaming
    if retry_ms is not None and not streaming:
        raise ValueError("a table has no timers")
    both.sparkSession.streams.active  # starts the coordinator that state needs, also for a table
    start = None if stored is None else stored.select("conversation_id", "message_key", "seq").groupBy("conversation_id")
    processor = BackfilledLog(capacity, retry_ms)
    return both.groupBy("conversation_id").transformWithStateInPandas(processor, OUTPUT, "Append" if streaming else "Update", "None" if retry_ms is None else "ProcessingTime", start)

"""The message log as a keyed stream.

State of a conversation: its last ``LOG_CAPACITY`` keys in order, the next
sequence number and the clearing time.  A message is accepted if it is later
than the clearing and its key is not among those held; a key that was pushed out
may come again, with a new number.  What is over capacity leaves at the end of a
micro-batch.  The state is bounded by the capacity for each conversation, whatever
the traffic; it is checkpointed by Spark and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engramlake.schema import LOG_CAPACITY

OUTPUT = "conversation_id string, message_key string, ts long, role string, seq long"
#: Rows that clear a conversation have this role.
CLEAR = "clear"


class MessageLog(StatefulProcessor):
    """Input: conversation_id, message_key, ts (ms), role, order (arrival)."""

    def __init__(self, capacity: int = LOG_CAPACITY):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getListState("keys", "message_key string")
        self.counter = handle.getValueState("counter", "next_seq long, cleared_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [k[0] for k in self.keys.get()] if self.keys.exists() else []
        seq, cleared = self.counter.get() if self.counter.exists() else (1, None)
        known, out = set(held), []
        batch = pd.concat(list(rows)).sort_values("order", kind="stable")
        for message, ts, role in zip(batch["message_key"], batch["ts"], batch["role"]):
            if role == CLEAR:
                held, known, cleared = [], set(), int(ts)
                continue
            if cleared is not None and not ts > cleared or message in known:
                continue
            known.add(message)
            held.append(message)
            out.append((key[0], message, ts, role, seq))
            seq += 1
        held = held[-self.capacity :]
        self.keys.put([(k,) for k in held]) if held else self.keys.clear()
        self.counter.update((seq, cleared))
        yield pd.DataFrame(out, columns=["conversation_id", "message_key", "ts", "role", "seq"])

    def close(self) -> None:
        pass


def numbered(messages: DataFrame, capacity: int = LOG_CAPACITY) -> DataFrame:
    """Accepted messages with their sequence numbers, of a stream or of a table."""
    messages.sparkSession.streams.active  # starts the coordinator that state needs, also for a table
    return messages.groupBy("conversation_id").transformWithStateInPandas(MessageLog(capacity), OUTPUT, "Append" if messages.isStreaming else "Update", "None")

"""Keys that end without an end marker: an event-time timer per key.

Every row moves its key's timer to the row's time plus a patience; when the watermark passes the
timer, the key is closed with what it has. One timer a key is kept, in a value state of its own.
"""

from __future__ import annotations

from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How far the watermark stays behind the latest time: rows of one time may be cut into two triggers.
DELAY = "1 second"


class PatientProcessor(StatefulProcessor):
    """A processor whose keys close ``patience_ms`` after their latest row (event time)."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def wait_from(self, latest_ms: int) -> None:
        """Move the key's timer to ``patience_ms`` after ``latest_ms``, never back."""
        at = self.due.get()[0] if self.due.exists() else None
        if at is None or latest_ms + self.patience_ms > at:
            self._move(at, latest_ms + self.patience_ms)

    def wait_until(self, due_ms: int) -> None:
        """Move the key's timer to ``due_ms``."""
        at = self.due.get()[0] if self.due.exists() else None
        if at != due_ms:
            self._move(at, due_ms)

    def _move(self, at: int | None, due_ms: int) -> None:
        if at is not None:
            self.handle.deleteTimer(at)
        self.handle.registerTimer(due_ms)
        self.due.update((due_ms,))

    def stop_waiting(self) -> None:
        """The key ended otherwise."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def close(self) -> None:
        pass


def latest_ms(times) -> int:
    """The latest of a column of times, in milliseconds (rounded up)."""
    return -(-int(times.max().value) // 1_000_000)

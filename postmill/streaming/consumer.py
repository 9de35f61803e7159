"""Reading an event log one event at a time, with acknowledgement.

Events have dense numbers, so an acknowledged number says exactly what was delivered: after a restart
the next one follows.  Each acknowledgement is a revision of a checkpoint, so of two consumers of one
store only one advances.  An epoch is sorted once and its rows are fetched as they are asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from postmill.streaming.checkpoint import Change, IncrementalStore, Store, changed, preflight
from postmill.streaming.listing_stream import EventLog
from postmill.streaming.search import Unacknowledged

_LOG = "log"


class Consumer:
    def __init__(self, log: EventLog, store: Store, fingerprint: str, explicit: bool = False) -> None:
        self.log, self.store, self.explicit = log, store, explicit
        self.checkpoint = preflight(store, fingerprint, {_LOG: 1})
        self.pending = None

    @property
    def _at(self) -> dict:
        return {"epoch": 0, "number": 0} | dict(self.checkpoint.sites[_LOG].state)

    def __iter__(self) -> Iterator:
        at = self._at
        for epoch in [e for e in self.log.epochs() if e >= at["epoch"]]:
            ahead = self.log.epoch(epoch).where(f"number > {at['number']}").orderBy("number")
            for row in ahead.toLocalIterator():
                if self.pending is not None:
                    if self.explicit:
                        raise Unacknowledged("acknowledge the last event first")
                    self.ack(self.pending[1])
                self.pending = (epoch, row)
                yield row
        if self.pending is not None and not self.explicit:
            self.ack(self.pending[1])

    def ack(self, row) -> None:
        """Acknowledge the event that was delivered last; doing it again changes nothing."""
        if self.pending is None:
            return
        epoch, last = self.pending
        if row is not last:
            raise ValueError("only the event that was delivered last can be acknowledged")
        c = self.checkpoint
        change = Change(c.fingerprint, c.generation, c.revision + 1, _LOG, {"epoch": epoch, "number": last.number})
        new = changed(c, change)
        if isinstance(self.store, IncrementalStore):
            self.store.apply(change)
        else:
            self.store.save(new)
        self.checkpoint, self.pending = new, None


def supervised(run: Callable[[], object], retries: int = 1, backoff: float = 0.5, retryable: Callable[[Exception], tuple[bool, float | None]] = lambda e: (False, None), sleep=time.sleep):
    """Run until it succeeds; failures that may pass are tried again after doubling waits, never
    sooner than the source asked for."""
    for attempt in range(retries + 1):
        try:
            return run()
        except Exception as error:
            again, asked = retryable(error)
            if not again or attempt == retries:
                raise
            sleep(max(backoff * 2**attempt, asked or 0.0))


"""A sign of life in the log while streams run."""

from __future__ import annotations

import time

from pyspark.sql.streaming import StreamingQueryListener

from quillfind.log import Logger

#: A fixed value: seconds between two signs.
EVERY_S = 300


class Heartbeat(StreamingQueryListener):
    """Logs at most once in every seconds that a stream makes progress or idles."""

    def __init__(self, log: Logger, every: float = EVERY_S, clock=time.monotonic) -> None:
        self.log, self.every, self.clock, self._last = log, every, clock, None

    def beat(self) -> bool:
        """Log, if it is time; was it?"""
        now = self.clock()
        if self._last is not None and now - self._last < self.every:
            return False
        self._last = now
        self.log.debug("Heartbeat", "alive")
        return True

    def onQueryStarted(self, event) -> None:  # noqa: N802  the interface's names
        self.beat()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.beat()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.beat()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

"""Progress of streaming queries: a line each EVERY input rows."""

from __future__ import annotations

import logging

from pyspark.sql.streaming import StreamingQueryListener

EVERY = 500


class Progress(StreamingQueryListener):
    """spark.streams.addListener(Progress()); rows counts the input rows of all queries, lines what was reported."""

    def __init__(self, every: int = EVERY, report=None):
        self.every, self.rows, self.lines = every, 0, []
        self.report = report or logging.getLogger("tagstream").info

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.add(event.progress.numInputRows, event.progress.processedRowsPerSecond)

    def add(self, rows: int, rate: float) -> None:
        before, self.rows = self.rows, self.rows + rows
        if self.rows // self.every > before // self.every:
            line = f"processed {self.rows} frames | {rate:.1f} a second"
            self.lines.append(line)
            self.report(line)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

"""Stages of a run in the log: how long each took, and the driver's memory."""

from __future__ import annotations

import json
import logging
import resource
import time
from contextlib import contextmanager

LOG = logging.getLogger("corvane")


class JsonLines(logging.Formatter):
    """One JSON object a line."""

    def format(self, record: logging.LogRecord) -> str:
        about = {"time": self.formatTime(record), "level": record.levelname, "message": record.getMessage()}
        return json.dumps(about | getattr(record, "about", {}))


def configure(level: str = "INFO", *, as_json: bool = False) -> None:
    """Send the engine's log to stderr, plain or as JSON lines."""
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    LOG.handlers[:] = [handler]
    LOG.setLevel(level)


@contextmanager
def stage(name: str):
    """Log the seconds of a block and the driver's largest memory so far, also if it fails."""
    start, failed = time.perf_counter(), True
    try:
        yield
        failed = False
    finally:
        seconds, peak = round(time.perf_counter() - start, 3), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
        LOG.info("%s %s in %.1f s, driver at most %d MB", name, "failed" if failed else "done", seconds, peak, extra={"about": {"stage": name, "seconds": seconds, "driver_mb": peak, "failed": failed}})

"""Log lines of a run on the driver: JSON, redacted, with the run's id."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import datetime, timezone
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from ..functions.redaction import redacted

ROOT = "ledgerloom"
_RUN: ContextVar[str] = ContextVar("run_id", default="unset")
_OWN = {*vars(logging.makeLogRecord({})), "message", "asctime", "run_id", "event"}


def level(name: str) -> int:
    """A level by name in any case; WARN is WARNING."""
    known = logging.getLevelNamesMapping()
    if name.upper() not in known:
        raise ValueError(f"no log level: {name!r}")
    return known[name.upper()]


def level_name(number: int) -> str:
    """DEBUG, INFO, WARN or ERROR, whatever is between or above."""
    return next(n for least, n in ((40, "ERROR"), (30, "WARN"), (20, "INFO"), (-1, "DEBUG")) if number >= least)


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        stamp = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        line = {k: v for k, v in vars(record).items() if k not in _OWN}
        line |= {"timestamp": stamp, "level": level_name(record.levelno), "run_id": getattr(record, "run_id", _RUN.get()), "event": getattr(record, "event", record.name), "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(redacted(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda v: redacted(str(v)))


def set_up(name: str = "INFO", out: TextIO | None = None) -> logging.Logger:
    """The library's logger with one handler, however often this is called."""
    logger = logging.getLogger(ROOT)
    handler = logging.StreamHandler(out or sys.stderr)
    handler.setFormatter(JsonLines())
    logger.handlers[:] = [handler]
    logger.setLevel(level(name))
    logger.propagate = False
    return logger


@contextmanager
def bound(run_id: str, spark: SparkSession | None = None) -> Iterator[None]:
    """Lines, and Spark's jobs as a tag, carry the run's id."""
    token = _RUN.set(run_id)
    if spark:
        spark.addTag(run_id)
    try:
        yield
    finally:
        if spark:
            spark.removeTag(run_id)
        _RUN.reset(token)


def tell(events: DataFrame, logger: logging.Logger) -> int:
    """A line for each drift event, row by row as they come; returns how many hashes diverge."""
    told = 0
    for row in events.orderBy("level", "content_hash").toLocalIterator():
        values = {k: v for k, v in row.asDict().items() if v is not None and k not in ("level", "event")}
        told += row.level == "WARN"
        logger.log(level(row.level), row.event, extra={"event": row.event} | values)
    return told

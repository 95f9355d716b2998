"""A session with settings for large tables, and a logger that carries context."""

from __future__ import annotations

import logging
from collections.abc import MutableMapping
from typing import Any

from pyspark.sql import SparkSession

from ferrograph.config import EngineConfig
from ferrograph.errors import ConfigError
from ferrograph.plans.store import shared_dir, ship

#: What a session gets unless it, or the caller, says otherwise.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def bootstrap(app: str = "ferrograph", config: EngineConfig | None = None, master: str | None = None, checkpoint_dir: str | None = None, **options: str) -> tuple[SparkSession, EngineConfig]:
    """A session (a running one is taken as it is, but for session settings it lacks) and validated settings.

    options: Spark settings, with _ for the dots. Off local mode a shared checkpoint folder is required.
    """
    config = config or EngineConfig()
    active = SparkSession.getActiveSession()
    wanted = DEFAULTS | {k.replace("_", "."): str(v) for k, v in options.items()}
    if checkpoint_dir:
        wanted["spark.checkpoint.dir"] = checkpoint_dir
    if active is None:
        builder = SparkSession.builder.appName(app).config(map=wanted)
        active = (builder.master(master) if master else builder).getOrCreate()
    else:
        for k, v in wanted.items():
            if active.conf.get(k, None) is None and active.conf.isModifiable(k):
                active.conf.set(k, v)
    shared_dir(active)
    ship(active)
    return active, config


class ContextLogger(logging.LoggerAdapter):
    """Writes `message [key=value, ...]`; `bind` gives a logger with more context."""

    def __init__(self, name: str = "ferrograph", **context: Any):
        super().__init__(logging.getLogger(name), context)

    def bind(self, **context: Any) -> ContextLogger:
        return ContextLogger(self.logger.name, **{**(self.extra or {}), **context})

    def process(self, msg: str, kwargs: MutableMapping[str, Any]) -> tuple[str, MutableMapping[str, Any]]:
        more = ", ".join(f"{k}={v}" for k, v in (self.extra or {}).items())
        return (f"{msg} [{more}]" if more else msg), kwargs


def set_level(level: str) -> None:
    """Of the package's logger, by name."""
    if level.upper() not in logging.getLevelNamesMapping():
        raise ConfigError("no such log level", level=level)
    logging.getLogger("ferrograph").setLevel(level.upper())

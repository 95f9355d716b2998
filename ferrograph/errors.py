"""Errors, each with the context it arose in."""

from __future__ import annotations

from datetime import datetime, timezone


class EngineError(Exception):
    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = context
        self.at = datetime.now(timezone.utc)

    def __str__(self) -> str:
        more = ", ".join(f"{k}={v!r}" for k, v in self.context.items())
        return super().__str__() + (f" ({more})" if more else "")


class DataError(EngineError): ...


class GraphError(EngineError): ...


class TrainingError(EngineError): ...


class InferenceError(EngineError): ...


class ConfigError(EngineError): ...

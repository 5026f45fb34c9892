"""Errors of the engine, what they say as a dictionary, and trying again after those that can be recovered from."""

from __future__ import annotations

import functools
import logging
import shutil
from collections.abc import Callable
from typing import Any

log = logging.getLogger(__name__)


class EngineError(Exception):
    """Base: a message, what it concerns, what may help, and whether trying again may."""

    kind = "engine"

    def __init__(self, message: str, context: dict | None = None, suggestion: str | None = None, recoverable: bool = False) -> None:
        super().__init__(message)
        self.context, self.suggestion, self.recoverable = context or {}, suggestion, recoverable

    def to_dict(self) -> dict:
        return {"kind": self.kind, "message": str(self), "context": self.context, "suggestion": self.suggestion, "recoverable": self.recoverable}


class RunError(EngineError):
    """Anything unexpected while a query runs."""

    kind = "run"


class ConfigurationError(EngineError):
    kind = "configuration"


class ValidationError(ConfigurationError):
    """A setting or argument with a value that can't be used."""

    kind = "validation"


class DataError(EngineError):
    kind = "data"


class SamplingError(EngineError):
    kind = "sampling"


class ClusteringError(EngineError):
    kind = "clustering"


class EvaluationError(EngineError):
    kind = "evaluation"


class ReportError(EngineError):
    """A report or chart table that can't be made."""

    kind = "report"


class ModelLoadError(EngineError):
    """What a producer of logits reports when its model can't be loaded."""

    kind = "model"


class CacheError(EngineError):
    kind = "cache"


class ResourceError(EngineError):
    """Memory, disk or executors that don't suffice."""

    kind = "resource"


class TimeLimitError(EngineError):
    kind = "time"


class CheckpointError(EngineError):
    kind = "checkpoint"


def _smaller_model(settings: dict) -> bool:
    if not settings.get("load_in_4bit"):
        settings["load_in_4bit"] = True
    elif settings.get("device") != "cpu":
        settings["device"] = "cpu"
    else:
        return False
    return True


def _without_cache(settings: dict) -> bool:
    if settings.get("cache_dir"):
        shutil.rmtree(settings["cache_dir"], ignore_errors=True)
    settings["enable_caching"] = False
    return True


def _less_at_once(settings: dict) -> bool:
    """Half the batch; at one, more partitions, so that each holds less."""
    if settings.get("batch_size", 1) > 1:
        settings["batch_size"] //= 2
    else:
        settings["partitions"] = 2 * settings.get("partitions", 1)
    return True


def _greedy(settings: dict) -> bool:
    if settings.get("sampler") == "greedy":
        return False
    settings["sampler"] = "greedy"
    return True


def _skip_invalid(settings: dict) -> bool:
    if "skip_invalid" in settings:
        return False
    settings["skip_invalid"] = True
    return True


#: What to change before trying again, by error; each returns whether there is anything left to change.
RECOVERIES: dict[type[EngineError], Callable[[dict], bool]] = {
    ModelLoadError: _smaller_model, CacheError: _without_cache, ResourceError: _less_at_once, SamplingError: _greedy, DataError: _skip_invalid,
}


def recover(error: EngineError, settings: dict[str, Any], recoveries: dict | None = None) -> bool:
    """Changes ``settings`` for another try; False for an error that isn't recoverable, has no recovery, or whose recovery fails."""
    found = (RECOVERIES if recoveries is None else recoveries).get(type(error))
    if not error.recoverable or found is None:
        log.warning("no recovery from %s", error.kind)
        return False
    try:
        return found(settings)
    except Exception:  # noqa: BLE001
        log.exception("recovery from %s failed", error.kind)
        return False


def recovering(tries: int = 3, recoveries: dict | None = None) -> Callable:
    """Decorator: runs a function of keyword settings again after errors that can be recovered from, ``tries`` times at most.

    Other exceptions come out as ``RunError``, with the first one as their cause.
    """

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args: Any, **settings: Any) -> Any:
            left = tries
            while True:
                try:
                    return f(*args, **settings)
                except EngineError as e:
                    if left <= 0 or not recover(e, settings, recoveries):
                        raise
                    left -= 1
                except Exception as e:
                    raise RunError(f"{f.__name__}: {e}") from e

        return run

    return wrap

"""Settings: YAML, environment, explicit overrides, checks."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from typing import Any

from pairlens.errors import ConfigurationError, ValidationError

PREFIX = "PAIRLENS_"
_REFERENCE = re.compile(r"\$\{([^}]+)\}")


@dataclass(frozen=True)
class Setting:
    """Type, default, range and choices of a setting; ``item`` is the type of a list's items, ``fields`` those of a group."""

    kind: type
    default: Any = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    item: type | None = None
    fields: dict | None = None
    about: str = ""


# Settings with their defaults and ranges.
SETTINGS: dict[str, Setting] = {
    "model_path": Setting(str, about="name or path of the model that makes the logits"),
    "benchmark": Setting(str, required=True, about="path of the questions"),
    "output_dir": Setting(str, "results", about="where results and reports go"),
    "limit": Setting(int, None, low=1, about="questions to take, all if unset"),
    "include_cot": Setting(bool, True, about="ask for a reasoning before the answer"),
    "log_level": Setting(str, "INFO", choices=("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), about="what is logged"),
    "load_in_4bit": Setting(bool, False, about="have the model in 4 bits"),
    "enable_caching": Setting(bool, True, about="keep vectors and clusters"),
    "debug_mode": Setting(bool, False, about="log each decision"),
    "enable_cluster_history": Setting(bool, False, about="record clusters and their masses"),
    "p_values": Setting(list, [0.9], low=0.0, high=1.0, item=float, about="nucleus sizes"),
    "cluster_params": Setting(dict, {}, about="clusters and candidates", fields={
        "k": Setting(int, 8, low=1, high=100, about="clusters"),
        "top_n": Setting(int, 50, low=1, high=1000, about="candidates"),
        "cache_size": Setting(int, 1000, low=0, about="entries kept"),
    }),
    "clustering_method": Setting(str, "dbscan", choices=("kmeans", "dbscan", "hierarchical"), about="how candidates are clustered"),
    "dbscan_eps": Setting(float, 0.3, low=0.01, high=10.0, about="distance of neighbours"),
    "dbscan_min_samples": Setting(int, 2, low=1, high=100, about="neighbours of a core"),
    "hierarchical_linkage": Setting(str, "average", choices=("average", "single", "complete", "ward"), about="distance of clusters"),
    "performance": Setting(dict, {}, about="size and time of the work", fields={
        "batch_size": Setting(int, 1, low=1, high=100, about="questions at once"),
        "memory_limit_gb": Setting(float, None, low=0.1, about="memory"),
        "timeout_seconds": Setting(int, 3600, low=1, about="seconds an operation may take"),
    }),
}


def resolve(value: Any, env: dict[str, str] | None = None) -> Any:
    """Puts environment values for ${NAME} or ${NAME:default}; a missing one without default raises."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def put(match: re.Match) -> str:
        name, has_default, default = match[1].partition(":")
        if name in env:
            return env[name]
        if has_default:
            return default
        raise ConfigurationError(f"environment variable {name} is not set", {"variable": name})

    return _REFERENCE.sub(put, value)


def parse(text: str, s: Setting) -> Any:
    """A setting's value from text, with the types of its items."""
    try:
        if s.kind is bool:
            low = text.strip().lower()
            if low not in ("true", "1", "yes", "on", "false", "0", "no", "off"):
                raise ValueError(text)
            return low in ("true", "1", "yes", "on")
        if s.kind is list:
            return [(s.item or str)(x.strip()) for x in text.split(",") if x.strip()]
        return s.kind(text)
    except ValueError as e:
        raise ConfigurationError(f"{text!r} is no {s.kind.__name__}") from e


def _checked(name: str, value: Any, s: Setting, errors: list[str]) -> None:
    if s.kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, s.kind) or (s.kind in (int, float) and isinstance(value, bool)):
        errors.append(f"{name} must be {s.kind.__name__}, not {type(value).__name__}")
        return
    if s.choices and value not in s.choices:
        errors.append(f"{name} must be one of {', '.join(map(str, s.choices))}")
    for x in value if s.kind is list else [value]:
        if s.item is not None and s.kind is list and not isinstance(x, (s.item, int) if s.item is float else s.item):
            errors.append(f"items of {name} must be {s.item.__name__}")
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            if s.low is not None and x < s.low:
                errors.append(f"{name} must be at least {s.low}")
            if s.high is not None and x > s.high:
                errors.append(f"{name} must be at most {s.high}")


def validate(given: dict[str, Any], settings: dict[str, Setting] | None = None, env: dict[str, str] | None = None, at: str = "") -> tuple[dict[str, Any], list[str]]:
    """The settings with defaults and the environment's overrides, and the names that aren't known; wrong values raise."""
    settings = SETTINGS if settings is None else settings
    env = os.environ if env is None else env
    given = resolve(given, env)
    out, errors = {}, []
    unknown = [at + k for k in given if k not in settings]
    for name, s in settings.items():
        variable = PREFIX + (at + name).upper().replace(".", "_")
        value = parse(env[variable], s) if variable in env and not s.fields else given.get(name)
        if s.fields is not None:
            value, more = validate(value or {}, s.fields, env, f"{at}{name}.")
            unknown += more
        elif value is None:
            if s.required:
                errors.append(f"{at}{name} is required")
                continue
            value = list(s.default) if isinstance(s.default, list) else s.default
        if value is not None and s.fields is None:
            _checked(at + name, value, s, errors)
            value = float(value) if s.kind is float and isinstance(value, int) else value
        out[name] = value
    if errors:
        raise ValidationError("; ".join(errors), {"errors": errors})
    return out, unknown


def merge(base: dict[str, Any], overrides: dict[str, Any]) -> dict[str, Any]:
    """``base`` with the overrides that are set: None leaves a value as it is, groups merge."""
    out = dict(base)
    for k, v in overrides.items():
        if v is None:
            continue
        out[k] = merge(out.get(k) or {}, v) if isinstance(v, dict) else v
    return out


def load(path: str, overrides: dict[str, Any] | None = None, env: dict[str, str] | None = None) -> tuple[dict[str, Any], list[str]]:
    """Settings from a YAML file."""
    import yaml

    if not os.path.exists(path):
        raise ConfigurationError(f"no such file: {path}")
    try:
        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
    except yaml.YAMLError as e:
        raise ConfigurationError(f"{path} is no YAML: {e}") from e
    if not isinstance(given, dict):
        raise ConfigurationError(f"{path} holds no settings")
    return validate(merge(given, overrides or {}), env=env)


def template() -> dict[str, Any]:
    """A starting point: every setting with its default."""

    def fill(settings: dict[str, Setting]) -> dict[str, Any]:
        return {k: fill(s.fields) if s.fields is not None else ("..." if s.required else s.default) for k, s in settings.items()}

    return fill(SETTINGS)


def described(settings: dict[str, Setting] | None = None, at: str = "") -> list[tuple[str, str, str, str]]:
    """Name, type, default and purpose of each setting, for a manual."""
    out = []
    for name, s in (SETTINGS if settings is None else settings).items():
        out.append((at + name, s.kind.__name__, "required" if s.required else "" if s.default is None else str(s.default), s.about))
        if s.fields is not None:
            out.extend(described(s.fields, f"{at}{name}."))
    return out


def switch(given: bool | None, name: str, otherwise: bool = False, env: dict[str, str] | None = None) -> bool:
    """A switch: as given, else as the environment says in words like yes or off, else ``otherwise``."""
    if given is not None:
        return given
    said = (os.environ if env is None else env).get(PREFIX + name.upper(), "").strip().lower()
    return True if said in ("true", "1", "yes", "on") else False if said in ("false", "0", "no", "off") else otherwise

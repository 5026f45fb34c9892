"""Command line: flags over a settings file, and the sweeps and samplers they ask for."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from typing import Any

from pairlens import config
from pairlens.errors import ValidationError

# Datasets and samplers that flags may name.
DATASETS = ("arc_easy", "arc_challenge", "hellaswag", "mmlu_stem")
SAMPLERS = ("greedy", "top_p", "dcbs", "random")

# Flags that set a setting, by its place in the settings.
SETS = {
    "--model": "model_path", "--benchmark": "benchmark", "--output-dir": "output_dir", "--limit": "limit", "--top-p": "p_values", "--k": "cluster_params.k", "--top-n": "cluster_params.top_n",
    "--clustering-method": "clustering_method", "--dbscan-eps": "dbscan_eps", "--dbscan-min-samples": "dbscan_min_samples", "--hierarchical-linkage": "hierarchical_linkage",
    "--log-level": "log_level", "--batch-size": "performance.batch_size",
}
# Flags that turn a setting on or off.
TURNS = {"--no-cot": ("include_cot", False), "--disable-cache": ("enable_caching", False), "--enable-caching": ("enable_caching", True), "--load-in-4bit": ("load_in_4bit", True), "--debug-mode": ("debug_mode", True), "--enable-cluster-history": ("enable_cluster_history", True)}
# Flags of the run alone.
PLAIN = ("--save-details", "--memory-profiling", "--enable-disagreement-tracking", "--list-checkpoints")


@dataclass(frozen=True)
class Run:
    """What a command line asks for."""

    settings: dict[str, Any]
    unknown: list[str]
    sweep: list[dict[str, Any]]
    samplers: tuple[str, ...]
    datasets: tuple[str, ...]
    temperature: float | None
    top_k: int | None
    run_id: str | None
    output_format: str
    switches: frozenset[str]


def _setting(place: str) -> config.Setting:
    group, _, name = place.rpartition(".")
    return (config.SETTINGS[group].fields if group else config.SETTINGS)[name]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pairlens", description="Evaluate ways to select a token, on Spark.")
    out.add_argument("--config", help="YAML file of settings; flags override it")
    for flag, place in SETS.items():
        s = _setting(place)
        out.add_argument(flag, type=s.item or s.kind, choices=s.choices or None, help=s.about)
    for flag, (place, value) in TURNS.items():
        out.add_argument(flag, action="store_true", help=f"{place} = {value}")
    for flag in PLAIN:
        out.add_argument(flag, action="store_true")
    for flag, kind in (("--sweep-k", int), ("--sweep-top-n", int), ("--sweep-top-p", float)):
        out.add_argument(flag, nargs="+", type=kind, help="values to try one after another")
    out.add_argument("--output-format", choices=("json", "csv", "both"), default="json")
    out.add_argument("--datasets", nargs="+", choices=(*DATASETS, "all"), default=["arc_easy"])
    out.add_argument("--samplers", nargs="+", choices=SAMPLERS)
    out.add_argument("--run-id")
    out.add_argument("--temperature", type=float)
    out.add_argument("--top-k", type=int)
    return out


def _put(tree: dict, place: str, value: Any) -> None:
    group, _, name = place.rpartition(".")
    (tree.setdefault(group, {}) if group else tree)[name] = value


def parse(arguments: Sequence[str], env: dict[str, str] | None = None) -> Run:
    """The run a command line asks for: flags over the environment over the file over the defaults.

    A temperature or a top-k that isn't above 0 raises ValidationError.
    """
    given = vars(parser().parse_args(arguments))
    value = lambda flag: given[flag[2:].replace("-", "_")]
    flags: dict[str, Any] = {}
    for flag, place in SETS.items():
        if value(flag) is not None:
            _put(flags, place, [value(flag)] if place == "p_values" else value(flag))
    for flag, (place, to) in TURNS.items():
        if value(flag):
            _put(flags, place, to)
    if given["config"]:
        settings, unknown = config.load(given["config"], flags, env)
    else:
        settings, unknown = config.validate(flags, env=env)
    # what a flag says stands above the environment
    settings = config.merge(settings, flags)
    if given["temperature"] is not None and given["temperature"] <= 0:
        raise ValidationError("temperature must be above 0")
    if given["top_k"] is not None and given["top_k"] < 1:
        raise ValidationError("top-k must be at least 1")
    tried = {place: given[name] for name, place in (("sweep_k", "cluster_params.k"), ("sweep_top_n", "cluster_params.top_n"), ("sweep_top_p", "p_values")) if given[name]}
    sweep = []
    for values in product(*tried.values()):
        one: dict[str, Any] = {}
        for place, v in zip(tried, values):
            _put(one, place, [v] if place == "p_values" else v)
        sweep.append(config.merge(settings, one))
    chosen = tuple(given["samplers"] or SAMPLERS)
    chosen += tuple(n for n, v in (("temperature", given["temperature"]), ("top_k", given["top_k"])) if v is not None)
    return Run(
        settings, unknown, sweep or [settings], chosen, DATASETS if "all" in given["datasets"] else tuple(given["datasets"]), given["temperature"], given["top_k"], given["run_id"],
        given["output_format"], frozenset(f for f in PLAIN if value(f)))

"""Settings, command line, and trying again after errors."""

import pytest

from pairlens import cli, config, errors


def test_every_setting_is_described_and_has_a_valid_default():
    names = {n for n, *_ in config.described()}
    assert {"benchmark", "include_cot", "cluster_params.cache_size", "performance.timeout_seconds", "hierarchical_linkage"} <= names
    got, unknown = config.validate({"benchmark": "b"}, env={})
    assert got["performance"] == {"batch_size": 1, "memory_limit_gb": None, "timeout_seconds": 3600} and got["include_cot"] is True and not unknown
    assert all(about for *_, about in config.described())


@pytest.mark.parametrize("bad", [
    {"performance": {"batch_size": 0}}, {"performance": {"batch_size": 101}}, {"performance": {"memory_limit_gb": 0.01}}, {"cluster_params": {"k": 101}}, {"cluster_params": {"top_n": "x"}},
    {"dbscan_eps": 11.0}, {"dbscan_eps": "near"}, {"hierarchical_linkage": "mean"}, {"include_cot": "yes"}, {"p_values": 0.9}, {"p_values": ["a"]}, {"log_level": "LOUD"}, {"limit": 1.5},
])
def test_values_out_of_range(bad):
    with pytest.raises(errors.ValidationError):
        config.validate({"benchmark": "b"} | bad, env={})


@pytest.mark.parametrize("name,text,want", [("INCLUDE_COT", "off", False), ("DBSCAN_EPS", "0.5", 0.5), ("LIMIT", "7", 7), ("PERFORMANCE_BATCH_SIZE", "3", {"batch_size": 3, "memory_limit_gb": None, "timeout_seconds": 3600})])
def test_environment(name, text, want):
    got, _ = config.validate({"benchmark": "b"}, env={config.PREFIX + name: text})
    assert want in (got.get(name.lower()), got["performance"])
    with pytest.raises(errors.ConfigurationError):
        config.validate({"benchmark": "b"}, env={config.PREFIX + "LIMIT": "many"})


def test_switches():
    assert config.switch(True, "debug", env={"PAIRLENS_DEBUG": "off"}) and config.switch(None, "debug", env={"PAIRLENS_DEBUG": "Yes"})
    assert not config.switch(None, "debug", True, {"PAIRLENS_DEBUG": "0"}) and config.switch(None, "debug", True, {"PAIRLENS_DEBUG": "perhaps"})


def test_flags_over_environment_over_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("benchmark: from_file\nlimit: 3\ndbscan_eps: 0.4\ncluster_params:\n  k: 5\n")
    got = cli.parse(["--config", str(path), "--limit", "9", "--top-n", "40", "--top-p", "0.8", "--no-cot", "--save-details"], env={"PAIRLENS_LIMIT": "4", "PAIRLENS_DBSCAN_EPS": "0.6"})
    s = got.settings
    assert (s["benchmark"], s["limit"], s["dbscan_eps"], s["cluster_params"]["k"], s["cluster_params"]["top_n"], s["p_values"], s["include_cot"]) == ("from_file", 9, 0.6, 5, 40, [0.8], False)
    assert got.switches == {"--save-details"} and got.samplers == cli.SAMPLERS and got.datasets == ("arc_easy",) and got.sweep == [s]


def test_sweeps_samplers_and_datasets():
    got = cli.parse(["--benchmark", "b", "--sweep-k", "2", "4", "--sweep-top-p", "0.5", "0.9", "--datasets", "all", "--samplers", "greedy", "dcbs", "--temperature", "0.7", "--top-k", "5", "--run-id", "r", "--output-format", "csv"], env={})
    assert [(x["cluster_params"]["k"], x["p_values"]) for x in got.sweep] == [(2, [0.5]), (2, [0.9]), (4, [0.5]), (4, [0.9])] and all(x["cluster_params"]["top_n"] == 50 for x in got.sweep)
    assert got.samplers == ("greedy", "dcbs", "temperature", "top_k") and got.datasets == cli.DATASETS and (got.temperature, got.top_k, got.run_id, got.output_format) == (0.7, 5, "r", "csv")


@pytest.mark.parametrize("flags", [["--temperature", "0"], ["--top-k", "0"], ["--k", "500"]])
def test_flags_out_of_range(flags):
    with pytest.raises(errors.ConfigurationError):
        cli.parse(["--benchmark", "b", *flags], env={})


@pytest.mark.parametrize("flags", [["--samplers", "best"], ["--clustering-method", "x"], ["--datasets", "other"], ["--limit", "x"], ["--nonsense"]])
def test_unknown_flags(flags):
    with pytest.raises(SystemExit):
        cli.parse(["--benchmark", "b", *flags], env={})


def test_errors_as_dictionaries():
    kinds = [c for c in vars(errors).values() if isinstance(c, type) and issubclass(c, errors.EngineError)]
    assert len({c.kind for c in kinds}) == len(kinds) >= 12
    assert errors.DataError("m", {"a": 1}, "s", True).to_dict() == {"kind": "data", "message": "m", "context": {"a": 1}, "suggestion": "s", "recoverable": True}


@pytest.mark.parametrize("error,before,after", [
    (errors.ModelLoadError, {}, [{"load_in_4bit": True}, {"load_in_4bit": True, "device": "cpu"}, None]),
    (errors.CacheError, {"enable_caching": True}, [{"enable_caching": False}]),
    (errors.ResourceError, {"batch_size": 4}, [{"batch_size": 2}, {"batch_size": 1}, {"batch_size": 1, "partitions": 2}]),
    (errors.SamplingError, {"sampler": "top_p"}, [{"sampler": "greedy"}, None]),
    (errors.DataError, {}, [{"skip_invalid": True}, None]),
    (errors.EvaluationError, {}, [None]),
])
def test_recoveries(error, before, after):
    settings = dict(before)
    assert not errors.recover(error("m"), dict(before))
    for want in after:
        assert errors.recover(error("m", recoverable=True), settings) == (want is not None)
        assert want is None or settings == want


def test_a_failing_recovery_is_none():
    assert not errors.recover(errors.DataError("m", recoverable=True), {}, {errors.DataError: lambda s: 1 / 0})


def test_trying_again():
    seen = []

    @errors.recovering(tries=3)
    def work(**settings):
        seen.append(dict(settings))
        if settings["batch_size"] > 1:
            raise errors.ResourceError("too much", recoverable=True)
        return "done"

    assert work(batch_size=8) == "done" and [s["batch_size"] for s in seen] == [8, 4, 2, 1]
    with pytest.raises(errors.ResourceError):
        work(batch_size=64)
    with pytest.raises(errors.RunError) as e:
        errors.recovering()(lambda: {}["x"])()
    assert isinstance(e.value.__cause__, KeyError)

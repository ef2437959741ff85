import json

import pytest

from panelwright.config import AppConfig, load_config, validate_config, write_default_config
from panelwright.operators.expressions import DEFAULT_INPUTS, FeatureDefinitionError, load_feature_definitions, parse_feature_candidates, validate


def test_defaults_round_trip(tmp_path):
    path = write_default_config(tmp_path / "a" / "c.json")
    assert load_config(path) == AppConfig() == load_config()


@pytest.mark.parametrize(
    ("values", "error"),
    [
        ({"model": {"n_estimators": 0}}, ValueError), ({"model": {"max_depth": 0}}, ValueError), ({"nope": 1}, ValueError), ({"model": {"nope": 1}}, ValueError),
        ({"model": 3}, TypeError), ([], TypeError), ({"deepseek": {"base_url": "http://x"}}, ValueError), ({"model": {"train_lookback_days": 50}}, ValueError),
        ({"selection": {"max_industry_fraction": 1.1}}, ValueError), ({"deepseek": {"proposal_count": 101}}, ValueError), ({"deepseek": {"model": " "}}, ValueError),
    ],
)
def test_bad_settings(tmp_path, values, error):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(values))
    with pytest.raises(error):
        load_config(path)


def test_bounds_are_inclusive_where_stated():
    c = AppConfig()
    c.model.subsample, c.model.target_winsor_quantile, c.selection.buffer_exit_multiplier = 1, 0, 1
    validate_config(c)
    c.model.target_winsor_quantile = 0.5
    with pytest.raises(ValueError, match="winsor"):
        validate_config(c)


GOOD = ["momentum_5", "-lag(volume, 1) + 2 / 3", "clip(return_1, -1, 1)", "ts_zscore(safe_div(amount, volume), 252)", "ema(abs(return_1), 2) * 1e3"]
BAD = [
    "", "1 + 2", "__import__('os').system('whoami')", "lag(adj_close, -1)", "lag(adj_close, 0)", "rolling_mean(volume, 1)", "lag(volume, 2.5)", "lag(volume, n)", "lag(volume, 253)",
    "volume ** 2", "volume > 1", "volume.real", "volume[0]", "abs + 1", "abs(volume, 1)", "clip(volume, 2, 1)", "target_rank", "open", "abs(x=volume)", "volume / 0", "volume + 1 / (1 - 1)",
    "True + volume", "volume + 1e13", "lambda: volume", "rolling_mean(3, 5)", "volume + " * 60 + "volume", "(" * 5 + "volume", "-" * 14 + "volume", "'a' + volume",
]


def test_what_is_allowed():
    for text in GOOD:
        assert validate(text, DEFAULT_INPUTS).fields
    for text in BAD:
        with pytest.raises(FeatureDefinitionError):
            validate(text, DEFAULT_INPUTS)


def test_definitions(tmp_path):
    ok = {"name": "ai_one_x", "expression": "volume + 1", "rationale": "Ten letters.", "expected_direction": "Positive"}
    items = [ok, ok | {"name": "ai_two"}, ok | {"expression": "volume+2"}, ok | {"name": "bad"}, ok | {"name": "ai_three", "expression": "amount", "rationale": "short"}, 7]
    items += [ok | {"name": "ai_four", "expression": "amount", "expected_direction": "up"}, ok | {"name": "ai_five", "expression": "amount", "screening": 1}, ok | {"name": "ai_six", "expression": "amount"}]
    valid, rejected = parse_feature_candidates({"features": items})
    assert [d.name for d in valid] == ["ai_one_x", "ai_six"] and valid[0].expected_direction == "positive"
    assert [r["index"] for r in rejected] == [1, 2, 3, 4, 5, 6, 7]
    path = tmp_path / "f.json"
    for payload in ([], items, {"features": 1}, {}):
        path.write_text(json.dumps(payload))
        with pytest.raises(FeatureDefinitionError):
            load_feature_definitions(path)
    path.write_text(json.dumps([ok]))
    assert load_feature_definitions(path)[0].to_dict().keys() == {"name", "expression", "rationale", "expected_direction", "source"}
    with pytest.raises(FileNotFoundError):
        load_feature_definitions(tmp_path / "none.json")


def test_all_faults_of_a_candidate_and_who_came_first():
    good = {"name": "ai_one", "expression": "lag(volume, 1)", "rationale": "Long enough."}
    items = [
        good | {"name": "One", "rationale": "short", "expression": "lag(volume, -1)"},
        good,
        good | {"name": "ai_two", "expression": " lag(volume,1) "},
        good | {"expression": "lag(amount, 1)"},
        good | {"name": "ai_two", "expression": "lag(amount, 1)", "expected_direction": " Positive ", "source": " "},
        good | {"name": "ai_three", "expression": "delta(amount, 1)", "screening": []},
        7,
    ]
    valid, rejected = parse_feature_candidates({"features": items})
    assert [(d.name, d.expected_direction, d.source) for d in valid] == [("ai_one", "unknown", "deepseek"), ("ai_two", "positive", "deepseek")]
    told = {r["index"]: r["reason"] for r in rejected}
    assert set(told) == {0, 2, 3, 5, 6}
    assert all(x in told[0] for x in ("name must", "rationale must", "window of lag"))
    assert told[2] == "its expression is that of #1" and told[3] == "its name is that of #1" and told[5] == "screening must be an object"


def test_limits_of_an_expression():
    for text in ("", "  ", None, "volume" + " " * 600, "+".join(["volume"] * 90), "-" * 14 + "volume", "volume +"):
        with pytest.raises(FeatureDefinitionError):
            validate(text, DEFAULT_INPUTS)

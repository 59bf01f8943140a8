"""Settings of a study: one table of paths with a default and a check each.

Values, overrides, files and error messages all come from the table; what it does not list is
an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from ..operators.features import BLOCKS, DESCRIPTORS
from ..operators.models import SPECS
from ..operators.regimes import DETECTORS
from ..operators.signals import RULES
from ..sources.bars import BARS_PER_YEAR


def text(x):
    return isinstance(x, str)


def flag(x):
    return isinstance(x, bool)


def settings(x):
    return isinstance(x, dict)


def number(least: float, below: float = float("inf")) -> Callable:
    return lambda x: isinstance(x, int | float) and not isinstance(x, bool) and least <= x < below


def whole(least: int) -> Callable:
    return lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= least


def one_of(*names) -> Callable:
    return lambda x: x in names


def many(check: Callable) -> Callable:
    return lambda x: isinstance(x, list | tuple) and all(map(check, x))


def maybe(check: Callable) -> Callable:
    return lambda x: x is None or check(x)


_share = lambda x: number(0)(x) and 0 < x < 1
_windows = many(whole(1))

# Paths and defaults of study files.
TABLE: dict[str, tuple] = {
    "experiment.name": ("baseline", text),
    "experiment.seed": (7, whole(0)),
    "experiment.notes": ("", text),
    "data.symbol": ("EURUSD", text),
    "data.timeframe": ("H1", one_of(*BARS_PER_YEAR)),
    "data.start": (None, maybe(lambda x: bool(str(x)))),
    "data.end": (None, maybe(lambda x: bool(str(x)))),
    "data.warmup_bars": (300, whole(0)),
    "features.blocks": (["returns", "trend", "momentum", "volatility", "structure", "volume", "session"], many(one_of(*BLOCKS))),
    "features.return_horizons": ([1, 3, 5, 10, 20, 50], _windows),
    "features.volatility_windows": ([14, 50, 200], _windows),
    "features.trend_windows": ([20, 50, 200], _windows),
    "labeling.method": ("triple_barrier", one_of("directional", "triple_barrier", "meta")),
    "labeling.horizon": (24, whole(1)),
    "labeling.atr_window": (14, whole(1)),
    "labeling.take_profit_atr": (1.0, number(0)),
    "labeling.stop_loss_atr": (1.0, number(0)),
    "labeling.deadband_atr": (0.25, number(0)),
    "labeling.primary": ("ma_crossover", one_of(*RULES)),
    "regime.method": ("kmeans", one_of(*DETECTORS)),
    "regime.n_regimes": (4, whole(1)),
    "regime.features": (["trend_strength", "vol_percentile", "momentum_score", "mean_reversion_score"], many(one_of(*DESCRIPTORS))),
    "regime.as_model_feature": (True, flag),
    "regime.specialised_models": (False, flag),
    "model.name": ("xgboost", one_of(*SPECS)),
    "model.params": ({}, settings),
    "model.decision_threshold": (0.5, number(0, 1.0000001)),
    "model.class_balance": (True, flag),
    "model.top_k_features": (None, maybe(whole(1))),
    "model.n_seeds": (1, whole(1)),
    "validation.scheme": ("expanding", one_of("expanding", "rolling")),
    "validation.n_folds": (6, whole(1)),
    "validation.test_size": (0.12, _share),
    "validation.min_train_size": (0.25, _share),
    "validation.embargo_bars": (48, whole(0)),
    "backtest.initial_capital": (10_000.0, number(0)),
    "backtest.cost_bps": (2.0, number(0)),
    "backtest.slippage_bps": (0.5, number(0)),
    "backtest.position_size": (1.0, number(0)),
    "backtest.execution_lag": (1, whole(0)),
    "backtest.min_holding_bars": (24, whole(0)),
    "backtest.bars_per_year": (6240, whole(1)),
    "backtest.volatility_target": (None, maybe(number(0))),
    "backtest.volatility_window": (100, whole(2)),
    "backtest.max_leverage": (3.0, number(0)),
    "backtest.session_hours": ([], many(one_of(*range(24)))),
    "evaluation.bootstrap_samples": (1000, whole(1)),
    "evaluation.confidence_level": (0.95, _share),
}


class Settings:
    """Values by path: s["model.name"]; unchanged once made."""

    def __init__(self, nested: dict | None = None):
        self._values = {path: default for path, (default, _) in TABLE.items()}
        self._take("", nested or {})

    def _take(self, path: str, value) -> None:
        if path in TABLE:
            if not TABLE[path][1](value):
                raise ValueError(f"{value!r} is no value for {path}")
            self._values[path] = value
        elif isinstance(value, dict) and (not path or any(p.startswith(f"{path}.") for p in TABLE)):
            for name, inner in value.items():
                self._take(f"{path}.{name}" if path else str(name), inner)
        else:
            near = [p for p in TABLE if p.startswith(path.rpartition(".")[0])]
            raise KeyError(f"unknown setting {path}; there are {near or list(TABLE)}")

    def __getitem__(self, path: str):
        return self._values[path]

    def section(self, name: str) -> dict:
        return {p.partition(".")[2]: v for p, v in self._values.items() if p.startswith(f"{name}.")}

    def to_dict(self) -> dict:
        return {name: self.section(name) for name in dict.fromkeys(p.partition(".")[0] for p in TABLE)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, default=str)

    def but(self, *changes: str) -> Settings:
        """A copy with changes such as `model.name=logistic`; values are JSON, or else text."""
        out = Settings(self.to_dict())
        for change in changes:
            path, eq, given = change.partition("=")
            if not eq:
                raise ValueError(f"{change!r} is not path=value")
            try:
                value = json.loads(given)
            except json.JSONDecodeError:
                value = given
            out._take(path.strip(), value)
        return out


def read(path: str) -> Settings:
    """Settings of a YAML or JSON file on the driver; what it leaves out keeps its default."""
    with open(path, encoding="utf-8") as file:
        if path.endswith(".json"):
            return Settings(json.load(file))
        import yaml

        return Settings(yaml.safe_load(file))

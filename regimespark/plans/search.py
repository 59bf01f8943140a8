"""The staged search: named sets of changes to a study, each of which changes little."""

from __future__ import annotations

from .settings import Settings

_META, _HOURS, _TOP = "labeling.method=meta", "backtest.session_hours=[7,8,9,10,11,12,13,14,15,16]", "model.top_k_features=20"
_LONGER = ["labeling.horizon=48", "backtest.min_holding_bars=48", "validation.embargo_bars=96"]
_H4 = ["data.timeframe=H4", "data.start=2010-01-01", "labeling.horizon=12", "backtest.min_holding_bars=12", "validation.embargo_bars=24"]
_D1 = ["data.timeframe=D1", "data.start=2005-01-01", "labeling.horizon=10", "backtest.min_holding_bars=10", "validation.embargo_bars=20"]
_SIX, _SINCE = "validation.n_folds=6", "data.start=2016-01-01"

# What all arms share, and the stages' arms with their changes.
COMMON = ["data.start=2020-01-01", "validation.n_folds=3", "regime.method=none", "model.name=random_forest", "evaluation.bootstrap_samples=300"]
ARMS: dict[str, dict[str, list[str]]] = {
    "levers": {
        "baseline": [],
        "session filter": [_HOURS],
        "top-20 features": [_TOP],
        "volatility target 10%": ["backtest.volatility_target=0.10"],
        "threshold 0.55": ["model.decision_threshold=0.55"],
        "horizon 48": _LONGER,
    },
    "meta": {
        "meta (MA crossover)": [_META],
        "meta + session": [_META, _HOURS],
        "meta + top-20": [_META, _TOP],
        "meta + session + top-20": [_META, _HOURS, _TOP],
        "meta, Donchian primary": [_META, "labeling.primary=donchian_breakout"],
        "meta, ADX-filtered primary": [_META, "labeling.primary=volatility_filtered_trend"],
        "meta, RSI primary": [_META, "labeling.primary=rsi_mean_reversion"],
    },
    "tune": {
        "meta best + threshold 0.55": [_META, _HOURS, "model.decision_threshold=0.55"],
        "meta best + threshold 0.60": [_META, _HOURS, "model.decision_threshold=0.60"],
        "meta best + xgboost": [_META, _HOURS, "model.name=xgboost"],
        "meta best + lightgbm": [_META, _HOURS, "model.name=lightgbm"],
        "meta best + logistic": [_META, _HOURS, "model.name=logistic"],
        "meta best + kmeans regimes": [_META, _HOURS, "regime.method=kmeans"],
        "meta best + horizon 48": [_META, _HOURS, *_LONGER],
    },
    "timeframe": {
        "meta on H4": [_META, *_H4],
        "meta on D1": [_META, *_D1],
        "meta on H4 + session": [_META, *_H4, _HOURS],
    },
    "consolidate": {
        "meta + top-20, 5 seeds": [_META, _TOP, "model.n_seeds=5"],
        "meta + top-20, 6 folds": [_META, _TOP, _SIX],
        "meta + top-20, from 2016": [_META, _TOP, _SINCE, _SIX],
        "meta + top-20 + vol target": [_META, _TOP, "backtest.volatility_target=0.10"],
        "meta + top-20, 5 seeds, 6 folds, 2016": [_META, _TOP, "model.n_seeds=5", _SINCE, _SIX],
    },
}


def arms(*stages: str) -> list[tuple[str, str, list[str]]]:
    """(stage, arm, changes) of the given stages, of all without any."""
    unknown = set(stages) - set(ARMS)
    if unknown:
        raise KeyError(f"unknown stages {sorted(unknown)}; there are {sorted(ARMS)}")
    return [(stage, name, changes) for stage, own in ARMS.items() if not stages or stage in stages for name, changes in own.items()]


def run(bars, base: Settings | None = None, *stages: str, workers: int = 4) -> list[dict]:
    """Ledger rows of all arms of the stages, best Sharpe first."""
    from . import study

    base, out = (base or Settings()).but(*COMMON), []
    for stage in dict.fromkeys(s for s, _, _ in arms(*stages)):
        out += study.sweep(bars, base, [(name, changes) for _, name, changes in arms(stage)], stage, workers=workers)
    return sorted(out, key=study.by_sharpe)

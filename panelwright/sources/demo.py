"""A seeded synthetic panel, for trials without a vendor."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd

# The industries that codes take in turn.
INDUSTRIES = ("银行", "电子", "医药", "机械", "消费", "化工", "公用事业", "计算机", "汽车", "建筑")
MOVE_LIMIT, MARKED_LIMIT = 0.095, 0.094


def daily_returns(days: int, industry: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Days by stocks: market and industry factors, five-day momentum, one-day
    reversal and a constant quality, within the daily limit."""
    n = len(industry)
    drift = 0.00015 * rng.standard_normal(n)
    factor = rng.normal(0.00015, 0.007, (days, 1)) + rng.normal(0, 0.004, (days, len(INDUSTRIES)))[:, industry]
    noise = rng.normal(0, 0.014, (days, n))
    out = np.zeros((days, n))
    for t in range(days):
        trend = out[t - 5 : t].mean(axis=0) if t >= 5 else 0.0
        last = out[t - 1] if t else 0.0
        out[t] = np.clip(factor[t] + drift + noise[t] + 0.12 * trend - 0.07 * last, -MOVE_LIMIT, MOVE_LIMIT)
    return out


def demo_panel(stocks: int = 80, days: int = 520, seed: int = 7) -> pd.DataFrame:
    if stocks < 20 or days < 300:
        raise ValueError("a demo panel needs 20 stocks and 300 days")
    rng = np.random.default_rng(seed)
    shape, industry = (days, stocks), np.arange(stocks) % len(INDUSTRIES)
    move = daily_returns(days, industry, rng)
    overnight = rng.normal(0, 0.0035, shape)
    halted = rng.random(shape) < 0.002
    step = np.where(halted, 0.0, (1 + overnight) * (1 + move - overnight) - 1)
    close = rng.uniform(6, 60, stocks) * np.cumprod(1 + step, axis=0)
    before = np.vstack([close[:1] / (1 + step[:1]), close[:-1]])
    opened = np.where(halted, before, before * (1 + overnight))
    spread = np.where(halted, 0.0, np.abs(rng.normal(0.009, 0.004, shape)))
    volume = np.where(halted, 0.0, rng.uniform(2e6, 3e7, stocks) * np.exp(rng.normal(0, 0.45, shape) + 5 * np.abs(move)))
    shares = rng.uniform(8e7, 2e9, stocks)
    day = np.repeat(np.arange(days), stocks)
    code = np.tile(np.arange(stocks), days)
    flat = {
        "open": opened, "high": np.maximum(opened, close) * (1 + spread), "low": np.minimum(opened, close) * (1 - spread), "close": close,
        "volume": volume, "amount": volume * (opened + close) / 2,
    }
    digits = {"volume": 2, "amount": 2}
    return pd.DataFrame(
        {
            "date": pd.bdate_range("2023-01-03", periods=days).strftime("%Y-%m-%d").to_numpy()[day],
            "code": np.char.zfill((code + 1).astype(str), 6),
            "industry": np.array(INDUSTRIES)[industry[code]],
            **{k: v.ravel().round(digits.get(k, 4)) for k, v in flat.items()},
            "adj_factor": 1.0,
            "market_cap": (close * shares).ravel().round(2),
            "turnover_rate": (volume / shares).ravel(),
            "listing_days": 300 + day,
            "is_st": (code < max(1, stocks // 40)) & (day > int(days * 0.75)),
            "is_suspended": halted.ravel(),
            "is_limit_up": (move >= MARKED_LIMIT).ravel(),
            "is_limit_down": (move <= -MARKED_LIMIT).ravel(),
        }
    )


def generate_demo_data(path: str | Path, stocks: int = 80, days: int = 520, seed: int = 7) -> Path:
    target = Path(path)
    panel = demo_panel(stocks, days, seed)
    target.parent.mkdir(parents=True, exist_ok=True)
    panel.to_csv(target, index=False)
    return target

"""Rolling measures of one ordered series in numpy: the last n rows at each row, NaN while there are fewer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def quotient(a: np.ndarray, b: np.ndarray, where: np.ndarray) -> np.ndarray:
    """a / b, NaN outside ``where``."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=where)


def ratio(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a / b by the rules of floating point, and where it is 0 / 0: NaN too, but not for want of an input, which is NaN itself."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.divide(a, b)
    return out, np.isnan(out) & ~np.isnan(a) & ~np.isnan(b)


def log_change(close: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """ln(close / close ``lag`` rows before), and where it is no number though both are there; NaN at the start. A price of 0 makes infinities."""
    out, lost = np.full(len(close), np.nan), np.zeros(len(close), bool)
    if len(close) > lag:
        with np.errstate(divide="ignore", invalid="ignore"):
            out[lag:] = np.log(ratio(close[lag:], close[:-lag])[0])
        lost[lag:] = np.isnan(out[lag:]) & ~np.isnan(close[lag:]) & ~np.isnan(close[:-lag])
    return out, lost


def over(x: np.ndarray, n: int, measure: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``measure`` along the last axis of the windows of ``n`` rows."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = measure(np.lib.stride_tricks.sliding_window_view(x, n))
    return out


def deviation(windows: np.ndarray) -> np.ndarray:
    """Sample deviation along the last axis without its NaN; NaN where fewer than two are left."""
    n = np.isfinite(windows).sum(axis=-1)
    mean = np.nansum(windows, axis=-1) / np.maximum(n, 1)
    square = np.nansum((windows - mean[:, None]) ** 2, axis=-1)
    return np.sqrt(quotient(square, np.maximum(n - 1, 1).astype(float), n > 1))


def volatility(change: np.ndarray, lost: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`deviation` of the last ``n`` changes, and where it is no number because one of them is not finite, as in SQL."""
    wild = lost | np.isinf(change)
    hit = over(wild, n, lambda windows: windows.any(axis=-1)) == 1
    return np.where(hit, np.nan, over(np.where(wild, np.nan, change), n, deviation)), hit


def exact_deviation(windows: np.ndarray) -> np.ndarray:
    return windows.std(axis=-1, ddof=1)


def mean(windows: np.ndarray) -> np.ndarray:
    return windows.mean(axis=-1)


def total(windows: np.ndarray) -> np.ndarray:
    return windows.sum(axis=-1)

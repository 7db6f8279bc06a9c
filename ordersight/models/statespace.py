"""Exact Gaussian likelihood of an ARMA process by a Kalman filter, for one series and several parameter sets at once.

The filter starts from the stationary distribution or from a diffuse one. The diffuse start needs neither stationarity
nor invertibility: the first observations, as many as there are states, only settle the state and count for nothing.
Variances are in units of the innovation variance, which is estimated from the standardised errors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIFFUSE = 1e6  # variance of a state nothing is known about
SETTLED = 1e-14  # relative change within a day below which the gain is taken as constant
LOOK = 16  # days between two looks at that change


@dataclass
class Filtered:
    """One-step errors and their variances per parameter set, and the predicted state after the last day."""

    errors: np.ndarray
    variances: np.ndarray
    state: np.ndarray
    spread: np.ndarray
    burn: int


def matrices(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition and noise loading of the lag polynomials; the first state is the process itself."""
    size = max(len(ar) - 1, len(ma))
    step, load = np.zeros((size, size)), np.zeros(size)
    step[: len(ar) - 1, 0] = -ar[1:]
    step[np.arange(size - 1), np.arange(1, size)] = 1.0
    load[: len(ma)] = ma
    return step, load


def stationary_spread(step: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Covariance that one more day leaves unchanged."""
    size = len(load)
    unchanged = np.linalg.solve(np.eye(size * size) - np.kron(step, step), np.outer(load, load).ravel())
    return unchanged.reshape(size, size)


def kalman_filter(w: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]], diffuse: bool) -> Filtered:
    """Filter ``w`` under every (ar, ma) pair; all pairs must have the same lengths."""
    parts = [matrices(ar, ma) for ar, ma in models]
    step, load = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    count, size = load.shape
    noise = load[:, :, None] * load[:, None, :]
    start = np.eye(size) * DIFFUSE
    spread = np.array([start if diffuse else stationary_spread(t, r) for t, r in parts])
    state = np.zeros((count, size))
    errors, variances = np.empty((count, len(w))), np.empty((count, len(w)))
    turned = step.transpose(0, 2, 1)
    t = 0
    for t in range(1, len(w) + 1):
        variance, carried = spread[:, 0, 0], step @ spread
        gain = carried[:, :, 0] / variance[:, None]
        error = w[t - 1] - state[:, 0]
        errors[:, t - 1], variances[:, t - 1] = error, variance
        state = (step @ state[:, :, None])[:, :, 0] + gain * error[:, None]
        after = carried @ turned - gain[:, :, None] * carried[:, None, :, 0] + noise
        if t % LOOK == 0:
            after = (after + after.transpose(0, 2, 1)) / 2
            if np.abs(after - spread).max() <= SETTLED * max(1.0, np.abs(after).max()):
                spread = after
                break
        spread = after
    variances[:, t:] = spread[:, 0, 0, None]
    gain = (step @ spread[:, :, :1])[:, :, 0] / spread[:, 0, 0, None]
    for day in range(t, len(w)):
        errors[:, day] = w[day] - state[:, 0]
        state = (step @ state[:, :, None])[:, :, 0] + gain * errors[:, day, None]
    return Filtered(errors, variances, state, spread, size if diffuse else 0)


def scaled_errors(found: Filtered) -> np.ndarray:
    """Per parameter set a vector whose sum of squares is smallest where the likelihood is largest."""
    errors, variances = found.errors[:, found.burn :], found.variances[:, found.burn :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return errors / np.sqrt(variances) * np.exp(np.log(variances).mean(axis=1, keepdims=True) / 2)


def log_likelihood(found: Filtered) -> tuple[float, float]:
    """(log-likelihood, innovation variance) of the first parameter set, the variance at its best value."""
    errors, variances = found.errors[0, found.burn :], found.variances[0, found.burn :]
    count = len(errors)
    sigma2 = float((errors**2 / variances).sum()) / count
    return -count / 2 * (np.log(2 * np.pi * max(sigma2, 1e-300)) + 1) - float(np.log(variances).sum()) / 2, sigma2


def prediction(
    y: np.ndarray, found: Filtered, ar: np.ndarray, ma: np.ndarray, differencing: np.ndarray, sigma2: float, steps: int
) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of the next values of ``y``, whose differences the filter saw."""
    step, load = matrices(ar, ma)
    size = len(load)
    seen = np.zeros((steps, size))  # how a later difference depends on the predicted state
    weight = np.zeros(steps)  # and on a shock so many days before it
    row, shock = np.eye(size)[0], load.copy()
    for h in range(steps):
        seen[h], weight[h] = row, shock[0]
        row, shock = row @ step, step @ shock
    later = np.array([[weight[h - j] if 1 <= j <= h else 0.0 for j in range(steps)] for h in range(steps)])
    spread = seen @ found.spread[0] @ seen.T + later @ later.T
    undo = np.zeros(steps)  # weights of the differences in a level
    values = list(y)
    for h, ahead in enumerate(seen @ found.state[0]):
        undo[h] = (h == 0) - sum(differencing[i] * undo[h - i] for i in range(1, min(h, len(differencing) - 1) + 1))
        values.append(ahead - sum(differencing[i] * values[-i] for i in range(1, len(differencing))))
    summed = np.array([[undo[h - j] if j <= h else 0.0 for j in range(steps)] for h in range(steps)])
    variance = np.einsum("hi,ij,hj->h", summed, spread, summed)
    return np.array(values[len(y) :]), np.sqrt(sigma2 * np.maximum(variance, 0.0))

"""Zero-phase filtering of a recording's samples: Butterworth band-pass and notch.

Second-order sections in double precision, odd extension at both ends, initial
state for a constant, forward then backward.
"""

from __future__ import annotations

import numpy as np


def bandpass_sections(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Rows (b0, b1, b2, a1, a2) of a Butterworth band-pass by the bilinear transform with pre-warping."""
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    centre, width = np.sqrt(w1 * w2), w2 - w1
    poles = []
    for k in range(order):
        p = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) * width / 2
        root = np.sqrt(p * p - centre**2)
        poles += [p + root, p - root]
    z = [(2 * rate + p) / (2 * rate - p) for p in poles]
    upper = sorted((p for p in z if p.imag > 0), key=abs)
    rows = [[1.0, 0.0, -1.0, -2 * p.real, abs(p) ** 2] for p in upper]
    out = np.array(rows)
    w = np.exp(-1j * 2 * np.arctan(centre / (2 * rate)))
    gain = np.prod([(b[0] + b[1] * w + b[2] * w**2) / (1 + b[3] * w + b[4] * w**2) for b in out])
    out[:, :3] *= abs(gain) ** (-1 / len(out))
    return out


def notch_section(at: float, quality: float, rate: float) -> np.ndarray:
    w = 2 * np.pi * at / rate
    g = 1 / (1 + np.tan(w / quality / 2))
    return np.array([[g, -2 * g * np.cos(w), g, -2 * g * np.cos(w), 2 * g - 1]])


#: Samples that are filtered at once.
CHUNK = 256


def _system(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The cascade of sections as one linear system: state' = A state + B u, y = C state + D u."""
    n = 2 * len(sections)
    big, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for i, (b0, b1, b2, a1, a2) in enumerate(sections.tolist()):
        s = 2 * i
        # this section's input is what the ones before put out: c state + d u
        into = np.array([b1 - a1 * b0, b2 - a2 * b0])
        big[s : s + 2] += into[:, None] * c[None]
        b[s : s + 2] = into * d
        big[s, s], big[s, s + 1], big[s + 1, s] = -a1, 1.0, -a2
        c, d = b0 * c, b0 * d
        c[s] += 1.0
    return big, b, c, d


def _blocks(sections: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """How a chunk's input and the state before it make its output (T, O) and the state after it (R, A to the length)."""
    a, b, c, d = _system(sections)
    observe, reach, power = np.zeros((length, len(b))), np.zeros((length, len(b))), np.eye(len(b))
    for k in range(length):
        observe[k] = c @ power
        reach[length - 1 - k] = power @ b
        power = a @ power
    impulse = np.concatenate([[d], observe[:-1] @ b])
    lag = np.subtract.outer(np.arange(length), np.arange(length))
    return np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0), observe, reach, power


def _run(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cascade over ``x``, from the state that a constant would have left: chunks as matrices, only the states one after the other."""
    a, b, *_ = _system(sections)
    state = np.linalg.solve(np.eye(len(b)) - a, b * x[0])
    length = min(CHUNK, len(x))
    to_output, observe, reach, power = _blocks(sections, length)
    whole = len(x) // length * length
    chunks = x[:whole].reshape(-1, length)
    pushed, states = chunks @ reach, np.empty((len(chunks), len(b)))
    for i in range(len(chunks)):
        states[i] = state
        state = power @ state + pushed[i]
    out = (chunks @ to_output.T + states @ observe.T).reshape(-1)
    rest = x[whole:]
    if not len(rest):
        return out
    k = len(rest)
    return np.concatenate([out, to_output[:k, :k] @ rest + observe[:k] @ state])


def zero_phase(sections: np.ndarray, x: np.ndarray, pad: int = 27) -> np.ndarray:
    """Forward and backward through all sections; any length, at some tens of nanoseconds a sample and section."""
    if len(x) < 2:
        return np.asarray(x, float)
    pad = min(pad, len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        y = _run(sections, y)[::-1]
    return y[pad : pad + len(x)].copy()

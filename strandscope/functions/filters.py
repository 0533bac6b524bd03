"""Digital filters on short numpy arrays, used inside tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import gcd

import numpy as np

BLOCK = 64
_FORMS: dict = {}  # block matrices of the filters met by this worker


def rate_ratio(fs_in: float, fs_out: float) -> tuple[int, int]:
    """(up, down) of fs_out / fs_in in lowest terms; rates are positive whole numbers."""
    a, b = round(fs_in), round(fs_out)
    if a <= 0 or b <= 0 or abs(a - fs_in) > 1e-9 or abs(b - fs_out) > 1e-9:
        raise ValueError(f"sampling rates must be positive integers, got {fs_in} and {fs_out}")
    g = gcd(a, b)
    return b // g, a // g


def resampling_taps(up: int, down: int) -> np.ndarray:
    """Anti-alias low-pass of a rational resampler: Kaiser-windowed (beta 5) sinc, ten zero crossings a side."""
    widest = max(up, down)
    half = 10 * widest
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    return taps / taps.sum() * up


def butterworth(order: int, low: float | None, high: float, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a low-pass, or of a band-pass when `low` is given."""
    k = np.arange(order)
    prototype = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is None:
        poles = prototype * warp(high)
        centre = 0.0
        numerator = np.array([1.0, 2.0, 1.0])
    else:
        w1, w2 = warp(low), warp(high)
        width, middle = w2 - w1, np.sqrt(w1 * w2)
        half = prototype * width / 2
        root = np.sqrt(half**2 - middle**2)
        poles = np.concatenate([half + root, half - root])
        centre = 2 * np.pi * np.arctan(middle / (2 * fs)) / np.pi
        numerator = np.array([1.0, 0.0, -1.0])
    z = (2 * fs + poles) / (2 * fs - poles)
    upper = z[z.imag > 1e-14]
    real = np.sort(z[np.abs(z.imag) <= 1e-14].real)
    sections = [[*numerator, -2 * p.real, abs(p) ** 2] for p in upper]
    for a, b in zip(real[::2], real[1::2]):
        sections.append([*numerator, -(a + b), a * b])
    sos = np.array(sections)
    at = np.exp(1j * centre * np.array([0, -1, -2]))
    gain = np.prod([(s[:3] @ at) / (at[0] + s[3] * at[1] + s[4] * at[2]) for s in sos])
    sos[0, :3] /= abs(gain)
    return sos


def _block_form(sos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sections in a row as two matrices, what a block of inputs and the states before it give (the block of outputs, then
    the states after it), and the states that a constant input of one comes to."""
    step, drive, observe, direct = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for b0, b1, b2, a1, a2 in sos:
        into, n = np.array([b1 - a1 * b0, b2 - a2 * b0]), drive.size
        step = np.block([[step, np.zeros((n, 2))], [np.outer(into, observe), np.array([[-a1, 1.0], [-a2, 0.0]])]])
        drive, observe, direct = np.append(drive, into * direct), np.append(b0 * observe, [1.0, 0.0]), b0 * direct
    powers = [np.eye(drive.size)]
    for _ in range(BLOCK):
        powers.append(powers[-1] @ step)
    impulse = np.array([direct, *(observe @ p @ drive for p in powers[:BLOCK - 1])])
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    spread = np.where(lag >= 0, impulse[np.clip(lag, 0, None)], 0.0)
    carry = np.array([powers[BLOCK - 1 - j] @ drive for j in range(BLOCK)]).T
    by_states = np.vstack([[observe @ p for p in powers[:BLOCK]], powers[BLOCK]])
    return np.vstack([spread, carry]), by_states, np.linalg.solve(np.eye(drive.size) - step, drive)


def _run_sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All sections in turn along axis 0, started in the steady state of the first sample."""
    n = x.shape[0]
    key = sos.tobytes()
    if key not in _FORMS:
        _FORMS[key] = _block_form(sos)
    by_inputs, by_states, rest = _FORMS[key]
    y = np.concatenate([x, np.repeat(x[-1:], -n % BLOCK, axis=0)])
    state = rest[:, None] * x[0][None, :]
    for at in range(0, y.shape[0], BLOCK):
        both = by_inputs @ y[at:at + BLOCK]
        both += by_states @ state
        y[at:at + BLOCK], state = both[:BLOCK], both[BLOCK:]
    return y[:n]


def pad_length(sos: np.ndarray) -> int:
    return 3 * (2 * len(sos) + 1)


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward along axis 0, the ends extended by odd reflection."""
    x = np.asarray(x, dtype=float)
    flat = x.reshape(x.shape[0], -1)
    p = pad_length(sos)
    if flat.shape[0] <= p:
        raise ValueError(f"a signal of {flat.shape[0]} samples is too short for this filter")
    longer = np.concatenate([2 * flat[0] - flat[p:0:-1], flat, 2 * flat[-1] - flat[-2:-p - 2:-1]])
    there = _run_sections(sos, longer)
    back = _run_sections(sos, there[::-1])[::-1]
    return back[p:-p].reshape(x.shape)


SPLINE_ROOT = 3 ** 0.5 - 2  # of 1 + 4 z + z ** 2: how the solution of the equations dies away
SPLINE_REACH = 32  # beyond which it is less than a double holds
SPLINE_WEIGHTS = SPLINE_ROOT ** np.abs(np.arange(-SPLINE_REACH, SPLINE_REACH + 1)) / 12 ** 0.5
SPLINE_FALL = SPLINE_ROOT ** np.arange(1, 2 * SPLINE_REACH)  # of what an end adds


def spline_second_derivatives(y: np.ndarray) -> np.ndarray:
    """Of the cubic spline through equally spaced points whose end pieces join without a knot.

    Inside, M[i - 1] + 4 M[i] + M[i + 1] is the given curve: a sum over near points, and what both ends add to it.
    """
    n = y.size
    bend = np.zeros(n)
    curve = 6 * (y[2:] - 2 * y[1:-1] + y[:-2])
    bend[1], bend[n - 2] = curve[0] / 6, curve[-1] / 6
    inner = n - 4
    if inner > 0 and not np.isfinite(curve).all():
        bend[2:-2] = np.nan  # every point counts everywhere
    elif inner > 0:
        near = np.convolve(curve[1:-1], SPLINE_WEIGHTS)[SPLINE_REACH - 1:SPLINE_REACH + inner + 1]
        first, last, far = bend[1] - near[0], bend[n - 2] - near[-1], SPLINE_ROOT ** (inner + 1)
        fall, square = SPLINE_FALL[:inner], 1 - far * far
        bend[2:-2] = near[1:-1]
        bend[2:2 + fall.size] += (first - far * last) / square * fall
        bend[n - 2 - fall.size:n - 2] += (last - far * first) / square * fall[::-1]
    bend[0] = 2 * bend[1] - bend[2]
    bend[n - 1] = 2 * bend[n - 2] - bend[n - 3]
    return bend


def spline_values(start: float, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """That spline through (start + i, y_i), four points or more, at x inside the range."""
    bend = spline_second_derivatives(y)
    u = x - start
    i = np.minimum(u.astype(np.intp), y.size - 2)
    u -= i
    step, third = np.diff(y), np.diff(bend) / 6
    out = third.take(i)
    for of in (bend / 2, step - (2 * bend[:-1] + bend[1:]) / 6, y):  # the cubic of each piece, highest power first
        out *= u
        out += of.take(i)
    return out


def sharpen(columns: np.ndarray, profile: np.ndarray, x: np.ndarray, fs: float, aperture: float = 0.125,
            cutoff: float = 35.0, order: int = 4, min_run: int = 4) -> np.ndarray:
    """Linear samples of a column profile plus the low band that averaging and joining lines take away.

    Each run of neighbouring columns is aperture corrected and, from `min_run` columns
    on, sampled by a spline; the difference to the linear samples is low-passed without
    phase shift and added back. Traces too short for the filter stay linear.
    """
    return sharpen_all([(columns, profile, x)], fs, aperture, cutoff, order, min_run)[0]


def sharpen_all(traces: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], fs: float, aperture: float = 0.125,
                cutoff: float = 35.0, order: int = 4, min_run: int = 4) -> list[np.ndarray]:
    """`sharpen` of many traces (columns, profile, x): those with equally many samples run through the filter side by side."""
    sos = _low_pass(order, cutoff, fs)
    out = [np.interp(x, columns, profile) for columns, profile, x in traces]
    sizes: dict[int, list[int]] = {}
    for i, (_, _, x) in enumerate(traces):
        if x.size > pad_length(sos):
            sizes.setdefault(x.size, []).append(i)
    for size, mine in sizes.items():
        added = np.empty((size, len(mine)))
        for k, i in enumerate(mine):
            added[:, k] = _restored(*traces[i], aperture, min_run) - out[i]
        for k, low in enumerate(np.ascontiguousarray(zero_phase(sos, added).T)):
            out[mine[k]] = out[mine[k]] + low
    return out


@lru_cache(maxsize=64)
def _low_pass(order: int, cutoff: float, fs: float) -> np.ndarray:
    return butterworth(order, None, cutoff, fs)


def _restored(columns: np.ndarray, profile: np.ndarray, x: np.ndarray, aperture: float, min_run: int) -> np.ndarray:
    """Samples of the aperture corrected profile, of its longer runs by splines."""
    corrected = profile.astype(float)
    cuts = np.flatnonzero(np.diff(columns) != 1) + 1
    runs = list(zip([0, *cuts.tolist()], [*cuts.tolist(), columns.size]))
    for a, b in runs:
        if b - a >= 2:
            p = profile[a:b]
            corrected[a:b] -= aperture * (np.concatenate([p[:1], p[:-1]]) - 2 * p + np.concatenate([p[1:], p[-1:]]))
    better, rest = np.empty(x.size), np.ones(x.size, dtype=bool)
    for a, b in runs:
        if b - a >= max(min_run, 4):
            inside = (x >= columns[a]) & (x <= columns[b - 1])
            if inside.any():
                better[inside] = spline_values(float(columns[a]), corrected[a:b], x[inside])
                rest &= ~inside
    better[rest] = np.interp(x[rest], columns, corrected)
    return better


def fractional_delay(x: np.ndarray, delay: float, pad: int = 100) -> np.ndarray:
    """Delay by part of a sample through a phase shift, with held ends on both sides."""
    if delay == 0:
        return x
    longer = np.pad(x.astype(float), ((pad, pad),) + ((0, 0),) * (x.ndim - 1), mode="edge")
    turn = np.exp(-2j * np.pi * np.fft.rfftfreq(longer.shape[0]) * delay)
    spectrum = np.fft.rfft(longer, axis=0) * turn.reshape((-1,) + (1,) * (x.ndim - 1))
    return np.fft.irfft(spectrum, n=longer.shape[0], axis=0)[pad:pad + x.shape[0]]


def quantised_lag(ref: np.ndarray, est: np.ndarray, levels: int, sigma: float | None = 0.5) -> tuple[int, float]:
    """Horizontal and vertical offset of two signals by correlating their drawings.

    Both are drawn on a (levels x time) raster, optionally blurred; the correlation peak
    against the reference's own peak gives the offsets.
    """
    low = min(np.nanmin(ref), np.nanmin(est))
    high = max(np.nanmax(ref), np.nanmax(est))
    width = max(ref.size, est.size)

    def drawing(s):
        t = np.flatnonzero(np.isfinite(s))
        level = np.round((levels - 1) * (s[t] - low) / (high - low) + 1).astype(int)
        raster = np.zeros((levels, width))
        raster[np.clip(level, 1, levels) - 1, t] = 1
        return _blur(raster, sigma) if sigma else raster

    a, b = drawing(ref), drawing(est)
    shape = (2 * levels - 1, 2 * width - 1)
    fa = np.fft.rfft2(a, shape)

    def peak(other):
        full = np.fft.irfft2(fa * np.fft.rfft2(other[::-1, ::-1], shape), shape)
        return np.unravel_index(np.argmax(np.round(full, 9)), full.shape)

    cross, own = peak(b), peak(a)
    return int(own[1] - cross[1]), float((own[0] - cross[0]) / (levels - 1) * (high - low))


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        wide = [(0, 0), (0, 0)]
        wide[axis] = (radius, radius)
        longer = np.pad(a, wide, mode="symmetric")
        a = sum(w[i] * np.take(longer, range(i, i + a.shape[axis]), axis=axis) for i in range(2 * radius + 1))
    return a


def _moving_average(x: np.ndarray, m: int) -> np.ndarray:
    """Causal mean of the last m samples along axis 0, zeros in front."""
    total = np.cumsum(x, axis=0, dtype=float)
    total[m:] -= total[:-m].copy()
    return total / m


def two_way_average(x: np.ndarray, m: int) -> np.ndarray:
    """Moving average forward and backward, with end states that make both orders agree best.

    The states in front of and behind the signal enter linearly, so they are the
    least-squares solution of "forward then backward = backward then forward".
    """
    n, order = x.size, min(m - 1, x.size)
    if order < 1:
        return np.asarray(x, dtype=float)
    front = np.zeros((n, order))
    front[np.arange(order), np.arange(order)] = 1.0  # state j shows up at sample j of an FIR filter
    behind = front[::-1]
    through = _moving_average(behind, m)
    matrix = np.hstack([through[::-1] - front, behind - through])
    there_back = _moving_average(_moving_average(x, m)[::-1], m)[::-1]
    back_there = _moving_average(_moving_average(x[::-1], m)[::-1], m)
    states = np.linalg.lstsq(matrix, back_there - there_back, rcond=None)[0]
    return there_back + np.hstack([through[::-1], behind]) @ states

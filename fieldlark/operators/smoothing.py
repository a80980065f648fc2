"""Fits per series that need a solver: Whittaker, harmonics, double logistic (numpy, many series an Arrow batch)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("sos", "pos", "eos", "lgp", "amplitude", "peak_value", "base_value", "integral", "rmse")


def _banded(diagonals: list[np.ndarray], right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric banded systems, one a row: ``diagonals[k][:, i]`` is the entry (i, i + k). LDL' without pivots."""
    width, n = len(diagonals) - 1, right.shape[1]
    low = [np.zeros_like(right) for _ in range(width + 1)]  # low[k][:, i] is L(i, i - k)
    d, x = np.empty_like(right), right.copy()
    for i in range(n):
        for k in range(min(width, i), -1, -1):
            j = i - k
            v = diagonals[k][:, j].copy()
            for m in range(k + 1, min(width, i) + 1):
                if j - (i - m) <= width:
                    v -= low[m][:, i] * d[:, i - m] * low[m - k][:, j]
            if k:
                low[k][:, i] = v / d[:, j]
            else:
                d[:, i] = v
        for k in range(1, min(width, i) + 1):
            x[:, i] -= low[k][:, i] * x[:, i - k]
    x /= d
    for i in range(n - 2, -1, -1):
        for k in range(1, min(width, n - 1 - i) + 1):
            x[:, i] -= low[k][:, i + k] * x[:, i + k]
    return x


def whittaker_rows(y: np.ndarray, lam: float = 10.0, order: int = 2, weights: np.ndarray | None = None, keep_gaps: bool = False) -> np.ndarray:
    """Penalised least squares of many series of one length, a row each; missing values have no weight. Series too short
    for the differences come back with their gaps as zero or, with ``keep_gaps``, as they are."""
    y = np.asarray(y, float)
    ok = np.isfinite(y)
    n = y.shape[1]
    if keep_gaps and n <= order + 1:
        return y.copy()
    filled = np.where(ok, y, 0.0)
    if n <= order:
        return filled
    w = np.where(ok, 1.0 if weights is None else weights, 0.0)
    d = np.diff(np.eye(order + 1), order, axis=0)[0]  # the differences' coefficients
    penalty = [np.zeros(n) for _ in range(order + 1)]
    for k in range(order + 1):
        for i in range(n - order):  # each difference adds its own products
            penalty[k][i : i + order + 1 - k] += d[: order + 1 - k] * d[k:]
    rows = [np.broadcast_to(lam * p, y.shape) for p in penalty]
    return _banded([w + rows[0] + 1e-12, *rows[1:]], w * filled)


def whittaker(y: np.ndarray, lam: float = 10.0, order: int = 2, weights: np.ndarray | None = None, keep_gaps: bool = False) -> np.ndarray:
    """``whittaker_rows`` of one series."""
    return whittaker_rows(np.asarray(y, float)[None], lam, order, None if weights is None else np.asarray(weights, float)[None], keep_gaps)[0]


def harmonics(t: np.ndarray, x: np.ndarray, n: int = 3, period: float | None = None, trend: bool = False) -> dict[str, float]:
    """Least squares on a constant (and a trend) and n harmonics: mean, amplitude and phase of each, rmse."""
    ok = np.isfinite(t) & np.isfinite(x)
    t, x = t[ok], x[ok]
    out = {"mean": np.nan, "rmse": np.nan} | {f"{k}{i}": np.nan for i in range(1, n + 1) for k in ("amp", "phase")}
    if not len(t):
        return out
    span = (period or float(np.ptp(t)) or 1.0) if not trend else 1.0
    cols = [np.ones_like(t)] + ([t] if trend else [])
    for i in range(1, n + 1):
        a = 2 * np.pi * i * t / span
        cols += [np.cos(a), np.sin(a)]
    m = np.column_stack(cols)[:, : len(t)]
    c = np.linalg.lstsq(m, x, rcond=None)[0]
    out |= {"mean": float(c[0]), "rmse": float(np.sqrt(np.mean((m @ c - x) ** 2)))}
    base = 2 if trend else 1
    for i in range(n):
        k = base + 2 * i
        if k + 1 < len(c):
            out[f"amp{i + 1}"] = float(np.hypot(c[k], c[k + 1]))
            out[f"phase{i + 1}"] = float(np.arctan2(c[k + 1], c[k]) if trend else np.arctan2(-c[k + 1], c[k]))
    return out


def _logistic(t, q):
    base, amp, sos, r1, eos, r2 = q
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return base + amp * (sig(r1 * (t - sos)) - sig(r2 * (t - eos)))


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems, NaN for those that are singular: no step then counts as better, and the damping rises."""
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:  # of any one
        if len(a) == 1:
            return np.full_like(b, np.nan)
        half = len(a) // 2
        return np.concatenate([_solved(a[:half], b[:half]), _solved(a[half:], b[half:])])


def fit_logistic(t: np.ndarray, x: np.ndarray, steps: int = 200) -> np.ndarray | None:
    """Bounded Levenberg-Marquardt from the data's own guess; None if it does not settle."""
    span = float(np.ptp(t))
    lo, hi = float(x.min()), float(x.max())
    if span <= 0 or hi - lo < 1e-9:
        return None
    peak = float(t[x.argmax()])
    q = np.array([lo, hi - lo, (t[0] + peak) / 2, 10 / span, (peak + t[-1]) / 2, 10 / span])
    low = np.array([lo - (hi - lo), 0, t[0] - span / 2, 1e-4 / span, t[0], 1e-4 / span])
    high = np.array([hi, 4 * (hi - lo), t[-1], 500 / span, t[-1] + span / 2, 500 / span])
    q, damp = np.clip(q, low, high), 1e-2
    cost = float(((_logistic(t, q) - x) ** 2).sum())
    for _ in range(steps):
        r = _logistic(t, q) - x
        h = np.maximum(np.abs(q), 1e-3) * 1e-6
        j = np.column_stack([(_logistic(t, q + h * (np.arange(6) == k)) - _logistic(t, q - h * (np.arange(6) == k))) / (2 * h[k]) for k in range(6)])
        a = j.T @ j
        step = _solved((a + damp * np.diag(np.diag(a) + 1e-12))[None], (j.T @ r)[None])[0]
        new = np.clip(q - step, low, high)
        c = float(((_logistic(t, new) - x) ** 2).sum())
        if c < cost:
            done = cost - c < 1e-12 * (1 + cost)
            q, cost, damp = new, c, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return q if np.isfinite(cost) else None


#: Series that are fitted at once.
STACK = 512


def _logistics(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``_logistic`` of a stack: times (series, steps), parameters (series, .., 6)."""
    base, amp, sos, r1, eos, r2 = (q[..., k, None] for k in range(6))
    t = t[(slice(None), *[None] * (q.ndim - 2))]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return base + amp * (sig(r1 * (t - sos)) - sig(r2 * (t - eos)))


def fit_logistics(series: list[tuple[np.ndarray, np.ndarray]], steps: int = 200) -> list[np.ndarray | None]:
    """``fit_logistic`` of many series (times, values) together.

    A step solves the six equations of all unsettled series in one call; each has a damping
    of its own and leaves the stack once it has settled. Series are stacked by length, the shorter ones filled up
    with steps of no weight.
    """
    out: list[np.ndarray | None] = [None] * len(series)
    able = [i for i, (t, x) in enumerate(series) if len(t) and np.ptp(t) > 0 and np.ptp(x) >= 1e-9]
    able.sort(key=lambda i: len(series[i][0]))
    for s in range(0, len(able), STACK):
        for i, q in zip(able[s : s + STACK], _stack_fitted([series[i] for i in able[s : s + STACK]], steps)):
            out[i] = q if np.isfinite(q).all() else None
    return out


def _stack_fitted(series, steps: int) -> np.ndarray:
    n = max(len(t) for t, _ in series)
    t, x, w = (np.zeros((len(series), n)) for _ in range(3))
    for i, (a, b) in enumerate(series):
        t[i, : len(a)], t[i, len(a) :], x[i, : len(a)], w[i, : len(a)] = a, a[-1], b, 1.0
    ends = np.array([(a[0], a[-1], np.ptp(a), a[b.argmax()], b.min(), b.max()) for a, b in series], float)
    t0, t1, span, peak, lo, hi = ends.T
    rise = hi - lo
    q = np.column_stack([lo, rise, (t0 + peak) / 2, 10 / span, (peak + t1) / 2, 10 / span])
    low = np.column_stack([lo - rise, 0 * lo, t0 - span / 2, 1e-4 / span, t0, 1e-4 / span])
    high = np.column_stack([hi, 4 * rise, t1, 500 / span, t1 + span / 2, 500 / span])
    q, damp = np.clip(q, low, high), np.full(len(q), 1e-2)
    miss = lambda i, p: (_logistics(t[i], p) - x[i]) * w[i]
    cost = (miss(slice(None), q) ** 2).sum(1)
    open_ = np.arange(len(q))
    eye = np.eye(6)
    for _ in range(steps):
        if not len(open_):
            break
        i = open_
        r = miss(i, q[i])
        h = np.maximum(np.abs(q[i]), 1e-3) * 1e-6
        moved = h[:, :, None] * eye
        j = (_logistics(t[i], q[i][:, None] + moved) - _logistics(t[i], q[i][:, None] - moved)) / (2 * h[:, :, None]) * w[i][:, None]
        a = j @ j.transpose(0, 2, 1)
        diag = np.einsum("skk->sk", a)
        a = a + eye * (damp[i, None] * (diag + 1e-12))[:, :, None]
        step = _solved(a, (j @ r[:, :, None])[:, :, 0])
        new = np.clip(q[i] - step, low[i], high[i])
        c = (miss(i, new) ** 2).sum(1)
        better = c < cost[i]
        done = better & (cost[i] - c < 1e-12 * (1 + cost[i]))
        q[i[better]], cost[i[better]] = new[better], c[better]
        damp[i] = np.where(better, damp[i] / 3, damp[i] * 4)
        open_ = i[~done & (better | (damp[i] <= 1e12))]
    q[~np.isfinite(cost)] = np.nan
    return q


def _crossing(t, y, level, rising):
    a, b = y[:-1], y[1:]
    hit = np.flatnonzero((a < level) & (b >= level) if rising else (a >= level) & (b < level))
    if not len(hit):
        return np.nan
    i = hit[0]
    return float(t[i] if b[i] == a[i] else t[i] + (level - a[i]) * (t[i + 1] - t[i]) / (b[i] - a[i]))


def _cleaned(t: np.ndarray, x: np.ndarray, smooth: float | None) -> tuple[np.ndarray, np.ndarray]:
    ok = np.isfinite(t) & np.isfinite(x)
    by = np.argsort(t[ok], kind="stable")
    t, x = t[ok][by], x[ok][by]
    return t, whittaker(x, smooth) if smooth and len(x) > 2 else x


def season(t: np.ndarray, x: np.ndarray, threshold: float = 0.5, smooth: float | None = None) -> dict[str, float]:
    """Season metrics of a fitted double logistic on a grid of 512 points, of the data itself where the fit fails."""
    return seasons([(t, x)], threshold, smooth)[0]


def seasons(series: list[tuple[np.ndarray, np.ndarray]], threshold: float = 0.5, smooth: float | None = None) -> list[dict[str, float]]:
    """``season`` of many series, fitted together."""
    clean = [_cleaned(t, x, smooth) for t, x in series]
    long = [i for i, (t, _) in enumerate(clean) if len(t) >= 6]
    fits = dict(zip(long, fit_logistics([clean[i] for i in long])))
    return [_metrics(t, x, fits.get(i), threshold) for i, (t, x) in enumerate(clean)]


def _metrics(t: np.ndarray, x: np.ndarray, q: np.ndarray | None, threshold: float) -> dict[str, float]:
    if not len(t):
        return dict.fromkeys(METRICS, np.nan) | {"success": 0.0}
    g = np.linspace(t[0], t[-1], 512) if q is not None else t
    y = _logistic(g, q) if q is not None else x
    k = int(y.argmax())
    base, peak = float(y.min()), float(y.max())
    level = base + threshold * (peak - base)
    sos, eos = _crossing(g[: k + 1], y[: k + 1], level, True), _crossing(g[k:], y[k:], level, False)
    sos, eos = (sos if np.isfinite(sos) else float(g[0])), (eos if np.isfinite(eos) else float(g[-1]))
    rmse = float(np.sqrt(np.mean((_logistic(t, q) - x) ** 2))) if q is not None else np.nan
    area = float(np.trapezoid(np.clip(y - base, 0, None), g)) if len(g) > 1 else 0.0
    return dict(zip(METRICS, (sos, float(g[k]), eos, max(eos - sos, 0.0), peak - base, peak, base, area, rmse))) | {"success": float(q is not None)}


def _series_batches(df: DataFrame, key: str, t: str, value: str, fn, ddl: str) -> DataFrame:
    """``fn`` over lists of whole series (key, times, values), each sorted by time; many at once, as many as a batch holds.

    A series has to fit a task, as its own rows meet in one.
    """
    held = df.select(key, t, F.col(value).cast("double").alias(value)).repartition(key).sortWithinPartitions(key, t)

    def run(batches):
        rest = None
        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            edges = _edges(table.column(0))
            whole, rest = table.slice(0, edges[-1]), table.slice(edges[-1])
            if whole.num_rows:
                yield fn(_parts(whole), b.schema.types[0])
        if rest is not None and rest.num_rows:
            yield fn(_parts(rest), rest.schema.types[0])

    def _edges(keys):
        c = keys.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])

    def _parts(table):
        edges = [*_edges(table.column(0)).tolist(), table.num_rows]
        keys, times, values = table.column(0), table.column(1), table.column(2).to_numpy()
        return [(keys[a].as_py(), times.slice(a, e - a), values[a:e]) for a, e in zip(edges, edges[1:])]

    return held.mapInArrow(run, ddl)


def _per_series(df: DataFrame, key: str, t: str, value: str, names: list[str], fn) -> DataFrame:
    """The figures ``names`` of every series; ``fn`` gives a list of them for a list of series (times, values)."""
    kind = df.schema[key].dataType.simpleString()

    def each(series, of):
        got = fn([(np.asarray(times.to_numpy(), float), x) for _, times, x in series])
        cols = [pa.array([k for k, _, _ in series], of), *[pa.array([g[n] for g in got], pa.float64()) for n in names]]
        return pa.RecordBatch.from_arrays(cols, names=[key, *names])

    ddl = f"{key} {kind}, " + ", ".join(f"{n} double" for n in names)
    return _series_batches(df, key, t, value, each, ddl)


def whittaker_series(df: DataFrame, key: str, t: str, value: str, lam: float = 10.0, order: int = 2) -> DataFrame:
    """(key, t, smooth) of every row. Series of one length are solved together."""
    k, tt = df.schema[key].dataType.simpleString(), df.schema[t].dataType.simpleString()

    def solved(series, of):
        out: list = [None] * len(series)
        sizes = np.array([len(x) for _, _, x in series])
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n).tolist()
            for i, row in zip(at, whittaker_rows(np.array([series[i][2] for i in at]), lam, order)):
                out[i] = row
        keys = pa.array([s[0] for s in series], of).take(pa.array(np.repeat(np.arange(len(series)), sizes)))
        return pa.RecordBatch.from_arrays([keys, pa.concat_arrays([c for s in series for c in s[1].chunks]), pa.array(np.concatenate(out))], names=[key, t, "smooth"])

    return _series_batches(df, key, t, value, solved, f"{key} {k}, {t} {tt}, smooth double")


def harmonic_series(df: DataFrame, key: str, t: str, value: str, n: int = 3, period: float | None = None, trend: bool = False) -> DataFrame:
    names = ["mean", "rmse"] + [f"{k}{i}" for i in range(1, n + 1) for k in ("amp", "phase")]
    return _per_series(df, key, t, value, names, lambda many: [harmonics(a, b, n, period, trend) for a, b in many])


def season_series(df: DataFrame, key: str, t: str, value: str, threshold: float = 0.5, smooth: float | None = None) -> DataFrame:
    return _per_series(df, key, t, value, [*METRICS, "success"], lambda many: seasons(many, threshold, smooth))


def phenometric_series(df: DataFrame, key: str, t: str, value: str, n: int = 3) -> DataFrame:
    """Season metrics, harmonics and plain statistics of every series, side by side."""
    stats = ["vi_mean", "vi_max", "vi_min", "vi_std", "vi_range"]
    names = [*METRICS, "success", "mean", *[f"{k}{i}" for i in range(1, n + 1) for k in ("amp", "phase")], *stats]

    def both(t, x, told):
        ok = x[np.isfinite(x)]
        some = len(ok) > 0
        plain = dict(zip(stats, (ok.mean(), ok.max(), ok.min(), ok.std(), np.ptp(ok)) if some else (np.nan,) * 5))
        h = harmonics(t, x, n)
        return told | {k: v for k, v in h.items() if k != "rmse"} | {k: float(v) for k, v in plain.items()}

    return _per_series(df, key, t, value, names, lambda many: [both(t, x, told) for (t, x), told in zip(many, seasons(many, 0.5, 5.0))])

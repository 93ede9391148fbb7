"""Numeric kernels that iterate: factorisation, ridge regression, phase correlation, circular convolution.

Each works on small state (books, Gram matrices, spectra) in Arrow batches; Spark spreads
the signals, groups or cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resonator(signal: np.ndarray, books: list[np.ndarray], iters: int = 40, floor: float = 0.2, hysteresis: float = 0.0, init: list[np.ndarray] | None = None) -> tuple[list[int], float, bool, int, list[list[float]]]:
    """Indices of one codeword from each book whose binding is the signal: (indices, score, converged, rounds, trace).

    All factors are refined at once from the estimates of the round before: the others
    are unbound, the rest is projected on the book by its own scores, and brought to the
    unit circle; ``hysteresis`` is the share of the old estimate that stays. Scores are
    magnitudes, so a factor's phase is free. It has converged when no index has changed
    for three rounds and the least score is at the floor. trace has each round's scores."""
    d = len(signal)
    unit = lambda v: v / np.where(np.abs(v) == 0, 1.0, np.abs(v))
    if not 0 <= hysteresis <= 1 or iters < 0 or floor < 0:
        raise ValueError("rounds and floor can't be negative, hysteresis is a share")
    if not np.isfinite(signal).all() or any(b.ndim != 2 or b.shape[1] != d or not len(b) for b in books):
        raise ValueError("a finite signal and books of its length are needed")
    est = [unit(v) for v in (init if init is not None else [b.sum(0) for b in books])]

    def read() -> tuple[list[int], list[float]]:
        each = [np.abs(b.conj() @ e) / d for b, e in zip(books, est)]
        return [int(x.argmax()) for x in each], [float(x.max()) for x in each]

    index, score = read()
    still, trace, done = 0, [], False
    for _ in range(iters):
        whole = np.prod(est, axis=0)
        new = []
        for b, e in zip(books, est):
            rest = signal * np.conj(whole * np.conj(e))  # e is on the unit circle, or 0 where nothing is known
            new.append(unit((1 - hysteresis) * unit((b.conj() @ rest) @ b) + hysteresis * e))
        est = new
        found, score = read()
        still = still + 1 if found == index else 0
        index = found
        trace.append(score)
        if still >= 3 and min(score) >= floor:
            done = True
            break
    return index, min(score), done, len(trace), trace


def factorize_all(signal: np.ndarray, books: list[np.ndarray], most: int, floor: float = 0.2) -> list[tuple[list[int], float, bool, int]]:
    """Objects found one after the other: (indices, amplitude, found, rounds). Each must have the floor's amplitude in
    what is left, and is taken away by it; the first failure ends the search and is returned."""
    out, rest = [], signal.copy()
    for _ in range(most):
        index, _, done, rounds, _ = resonator(rest, books, floor=floor)
        code = np.prod([b[i] for b, i in zip(books, index)], axis=0)
        amplitude = float((np.conj(code) @ rest).real / len(rest))
        done = bool(done and amplitude >= floor)
        out.append((index, amplitude, done, rounds))
        if not done:
            break
        rest = rest - amplitude * code
    return out


def grid_codebook(column: np.ndarray, values: np.ndarray, sign: int = 1) -> np.ndarray:
    """Codewords of the values of one axis: e^{+-i v w}, a row each."""
    return np.exp(sign * 1j * np.outer(values, column))


def product_codebook(books: list[np.ndarray]) -> np.ndarray:
    """All bindings of one codeword from each book, the last book fastest."""
    out = books[0]
    for b in books[1:]:
        out = (out[:, None] * b[None]).reshape(-1, b.shape[1])
    return out


def butterfly(query: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Scores of all rotation products: with k angles vectors there are 2^k rows, row i being the product of
    e^{i a_b} over the set bits b of i; each angle halves the rows by sums, so the last step has one column each."""
    x = query[None, :]
    out = np.array([x[0]])
    for a in angles[::-1]:
        out = np.concatenate([out, out * np.exp(-1j * a)[None, :]])
    return np.abs(out.sum(1)) / len(query)


def hrr_cleanup(query: np.ndarray, book: np.ndarray) -> tuple[int, float]:
    """The real codeword of the best cosine, the first of equals."""
    n = np.linalg.norm(book, axis=1) * max(float(np.linalg.norm(query)), 1e-30)
    score = book @ query / np.where(n == 0, 1.0, n)
    return int(score.argmax()), float(score.max())


def hrr_unbind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular correlation: what was bound to b."""
    return np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), len(a))


def factor_signals(signals: DataFrame, key: str, books: list[np.ndarray], most: int = 1) -> DataFrame:
    """(key, k, indices, score, converged, rounds) of packed signals with array columns re and im."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, re, im in zip(pdf[key], pdf["re"], pdf["im"]):
                for n, (i, s, ok, step) in enumerate(factorize_all(np.array(re) + 1j * np.array(im), books, most)):
                    rows.append((k, n, i, s, ok, step))
            yield pd.DataFrame(rows, columns=[key, "k", "indices", "score", "converged", "rounds"])

    kind = signals.schema[key].dataType.simpleString()
    return signals.select(key, "re", "im").mapInPandas(run, f"{key} {kind}, k int, indices array<int>, score double, converged boolean, rounds int")


def ridge(rows: DataFrame, features: list[str], target: str, lam: float) -> np.ndarray:
    """Weights of ridge regression with an intercept last: the Gram matrix is summed over
    tasks as (features + 1)^2 numbers, and solved on the driver."""
    x = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    n = len(x)
    sums = [F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.sum(x[i] * F.col(target)) for i in range(n)]
    got = [v or 0.0 for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    g, at = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = got[at]
            at += 1
    penalty = lam * np.eye(n)
    penalty[-1, -1] = 1e-12
    return np.linalg.solve(g + penalty, np.array(got[at:]))


def ridge_by_group(rows: DataFrame, key: str, features: list[str], target: str, lam: float) -> DataFrame:
    """(key, weights) of each group's own ridge fit, from its Gram sums; no group's rows meet in a task."""
    x = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    n = len(x)
    g = rows.groupBy(key).agg(F.array(*[F.sum(x[i] * x[j]) for i in range(n) for j in range(n)]).alias("g"), F.array(*[F.sum(x[i] * F.col(target)) for i in range(n)]).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = [np.linalg.solve(np.array(a).reshape(n, n) + lam * np.eye(n), np.array(b)).tolist() for a, b in zip(pdf["g"], pdf["b"])]
            yield pd.DataFrame({key: pdf[key], "weights": w})

    kind = rows.schema[key].dataType.simpleString()
    return g.mapInPandas(run, f"{key} {kind}, weights array<double>")


def phase_correlation(a: np.ndarray, b: np.ndarray, freqs: np.ndarray, grid: np.ndarray, whiten: bool = True) -> tuple[np.ndarray, float]:
    """The shift of a grid at which b's spectrum is best laid on a's, and its score; zero energy scores 0."""
    cross = a * np.conj(b)
    if whiten:
        m = np.abs(cross)
        cross = np.divide(cross, m, out=np.zeros_like(cross), where=m > 1e-12)
    total = np.abs(cross).sum()
    if total == 0:
        return grid[0], 0.0
    score = (np.exp(1j * grid @ freqs.T) @ cross).real / total
    return grid[int(score.argmax())], float(score.max())


def circular_convolution(a: list[float], b: list[float]) -> np.ndarray:
    """Binding of real vectors."""
    return np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), len(a))


def hrr_bind(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "bound": [circular_convolution(x, y).tolist() for x, y in zip(pdf["_a"], pdf["_b"])]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(a).alias("_a"), F.col(b).alias("_b")).mapInPandas(run, f"{key} {kind}, bound array<double>")


def project(gram: np.ndarray, rhs: np.ndarray, eps: float, tikhonov: float | None = None) -> np.ndarray:
    """Least squares through eigenvalues: those under ``eps`` of the largest are cut, or damped."""
    w, v = np.linalg.eigh(gram)
    gain = w / (w * w + tikhonov**2) if tikhonov is not None else np.where(w > eps * w.max(), 1 / np.maximum(w, 1e-300), 0)
    return v @ (gain[:, None] * (v.conj().T @ rhs))


class Diverged(ValueError):
    """A projection whose result is larger than what was projected by more than was allowed."""


def band_operator(gram: np.ndarray, keep: float | None = None, eps: float = 1e-6, tikhonov: float | None = None) -> np.ndarray:
    """The matrix that takes right-hand sides to weights: eigenvalues are kept down to ``eps`` of the largest, or,
    with ``keep``, only the largest that hold that share of their sum; or all are damped."""
    w, v = np.linalg.eigh(gram)
    if tikhonov is not None:
        gain = w / (w * w + tikhonov**2)
    else:
        order = np.argsort(w)[::-1]
        rank = int((w > eps * max(w.max(), 0)).sum())
        if keep is not None:
            total = np.cumsum(np.maximum(w[order], 0))
            rank = min(rank, int(np.searchsorted(total, keep * total[-1]) + 1)) if total[-1] > 0 else 0
        gain = np.zeros_like(w)
        gain[order[:rank]] = 1 / w[order[:rank]]
    return (v * gain) @ v.conj().T


def project_cells(cells: DataFrame, keys: list[str], gram: np.ndarray, eps: float = 1e-6, keep: float | None = None, tikhonov: float | None = None, most: float | None = None) -> DataFrame:
    """(keys, re, im, ratio): each cell's bundle (arrays re, im) projected by one operator of its band, which goes to
    all tasks (dim^2 numbers); ratio is the result's size over the bundle's. If the median ratio is over ``most``: an error."""
    op = band_operator(gram, keep, eps, tikhonov)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = np.array(pdf["re"].tolist()) + 1j * np.array(pdf["im"].tolist()) if len(pdf) else np.zeros((0, len(op)))
            x = b @ op.T
            size = np.linalg.norm(b, axis=1)
            out = {k: pdf[k] for k in keys} | {"re": x.real.tolist(), "im": x.imag.tolist(), "ratio": np.linalg.norm(x, axis=1) / np.where(size == 0, 1, size)}
            yield pd.DataFrame(out)

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    out = cells.select(*keys, "re", "im").mapInPandas(run, f"{kinds}, re array<double>, im array<double>, ratio double")
    if most is not None:
        middle = out.agg(F.percentile("ratio", F.lit(0.5))).first()[0]
        if middle is not None and middle > most:
            raise Diverged(f"the median ratio is {middle:.3g}, over {most}")
    return out

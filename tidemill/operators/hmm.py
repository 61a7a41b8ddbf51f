"""Hidden Markov models by expectation maximisation: discrete, Gaussian and Gaussian-mixture emissions.

Each iteration is one Spark job: every task runs forward and backward over its sequences in log space and returns summed
statistics of fixed size, which are added up and turned into new parameters on the driver. Statistics of all sequences are accumulated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.common import require
from tidemill.operators.sequences import per_sequence


def log_sum(x: np.ndarray, axis=None) -> np.ndarray:
    """log of a sum of exponentials; minus infinity for none."""
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return np.squeeze(out, axis=axis) if axis is not None else float(out.reshape(-1)[0])


def log_or_never(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def normalized(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Shares of a sum; all zeros stay zeros."""
    total = x.sum(axis=axis, keepdims=True)
    return x / np.where(total == 0, 1.0, total)


def forward(first: np.ndarray, steps: np.ndarray, frames: np.ndarray) -> np.ndarray:
    out = np.empty_like(frames)
    out[0] = first + frames[0]
    for t in range(1, len(frames)):
        out[t] = log_sum(out[t - 1][:, None] + steps, axis=0) + frames[t]
    return out


def backward(steps: np.ndarray, frames: np.ndarray) -> np.ndarray:
    out = np.zeros_like(frames)
    for t in range(len(frames) - 2, -1, -1):
        out[t] = log_sum(steps + (frames[t + 1] + out[t + 1])[None], axis=1)
    return out


def best_path(first: np.ndarray, steps: np.ndarray, frames: np.ndarray) -> tuple[float, np.ndarray]:
    """Log probability and states of the most probable path, first maximum on ties."""
    score, back = first + frames[0], np.zeros(frames.shape, int)
    for t in range(1, len(frames)):
        ahead = score[:, None] + steps
        back[t] = ahead.argmax(axis=0)
        score = ahead.max(axis=0) + frames[t]
    path = np.empty(len(frames), int)
    path[-1] = score.argmax()
    for t in range(len(frames) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return float(score.max()), path


def gaussian_log_density(x: np.ndarray, means: np.ndarray, covars: np.ndarray, kind: str = "diag") -> np.ndarray:
    """(n, k) log densities. Covariances: diag (k, d), spherical (k,), tied (d, d), full (k, d, d); one that isn't definite is tried once more with a little added."""
    n, d = x.shape
    if kind in ("diag", "spherical"):
        var = covars if kind == "diag" else np.repeat(np.asarray(covars).reshape(-1, 1), d, axis=1)
        gap = (x[:, None, :] - means[None]) ** 2 / var[None]
        return -0.5 * (d * np.log(2 * np.pi) + np.log(var).sum(axis=1)[None] + gap.sum(axis=2))
    out = np.empty((n, len(means)))
    for k, mean in enumerate(means):
        cov = covars if kind == "tied" else covars[k]
        try:
            low = np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            low = np.linalg.cholesky(cov + 1e-7 * np.eye(d))
        gap = np.linalg.solve(low, (x - mean).T)
        out[:, k] = -0.5 * (d * np.log(2 * np.pi) + (gap**2).sum(axis=0)) - np.log(np.diag(low)).sum()
    return out


def checked_covars(covars: np.ndarray, kind: str, k: int, d: int) -> np.ndarray:
    """Covariances of the right shape and positive, else an error."""
    shapes = {"diag": (k, d), "spherical": (k,), "tied": (d, d), "full": (k, d, d)}
    if kind not in shapes:
        raise ValueError(f"no covariance type {kind!r}")
    covars = np.asarray(covars, dtype=float)
    if covars.shape != shapes[kind]:
        raise ValueError(f"{kind} covariances have shape {covars.shape}, not {shapes[kind]}")
    if kind in ("diag", "spherical"):
        if (covars <= 0).any():
            raise ValueError("variances must be positive")
    else:
        for c in covars.reshape(-1, d, d):
            if not np.allclose(c, c.T) or (np.linalg.eigvalsh(c) <= 0).any():
                raise ValueError("covariances must be symmetric and positive definite")
    return covars


class Hmm:
    """Start and step probabilities with some kind of emission; subclasses give log densities, statistics and their maximisation."""

    def __init__(self, states: int = 1, start_prior: float = 1.0, step_prior: float = 1.0, iterations: int = 10, tolerance: float = 1e-2, seed: int = 0, update: str = "ste"):
        self.states, self.start_prior, self.step_prior = states, start_prior, step_prior
        self.iterations, self.tolerance, self.seed, self.update = iterations, tolerance, seed, update
        self.start = np.full(states, 1 / states)
        self.steps = np.full((states, states), 1 / states)
        self.history: list[float] = []

    # -- one sequence

    def frames(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def score(self, x: np.ndarray) -> float:
        """Log likelihood."""
        return log_sum(forward(log_or_never(self.start), log_or_never(self.steps), self.frames(x))[-1])

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        frames, steps = self.frames(x), log_or_never(self.steps)
        total = forward(log_or_never(self.start), steps, frames) + backward(steps, frames)
        return np.exp(total - log_sum(total, axis=1)[:, None])

    def decode(self, x: np.ndarray, how: str = "viterbi") -> tuple[float, np.ndarray]:
        if how == "map":
            p = self.posteriors(x)
            return float(np.log(p.max(axis=1)).sum()), p.argmax(axis=1)
        return best_path(log_or_never(self.start), log_or_never(self.steps), self.frames(x))

    def stationary(self) -> np.ndarray:
        """The distribution that the steps leave as it is."""
        values, vectors = np.linalg.eig(self.steps.T)
        v = np.real(vectors[:, np.argmin(np.abs(values - 1))])
        return v / v.sum()

    def sample(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """``n`` observations and their states."""
        random, s, states = np.random.default_rng(seed), None, []
        for _ in range(n):
            s = random.choice(self.states, p=self.start if s is None else self.steps[s])
            states.append(s)
        return np.array([self.emit(s, random) for s in states]), np.array(states)

    def emit(self, state: int, random: np.random.Generator):
        raise NotImplementedError

    # -- fitting

    def begin(self, sample: np.ndarray) -> None:
        """First emission parameters from a bounded sample."""

    def statistics(self, x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        raise NotImplementedError

    def maximise(self, stats: list[np.ndarray]) -> None:
        raise NotImplementedError

    def expectation(self, x: np.ndarray) -> list[np.ndarray]:
        frames, steps = self.frames(x), log_or_never(self.steps)
        a, b = forward(log_or_never(self.start), steps, frames), backward(steps, frames)
        like = log_sum(a[-1])
        p = np.exp(a + b - like)
        pairs = np.zeros((self.states, self.states))
        if len(x) > 1:
            pairs = np.exp(log_sum(a[:-1, :, None] + steps[None] + (frames[1:] + b[1:])[:, None, :] - like, axis=0))
        return [np.array([like]), p[0], pairs, *self.statistics(x, p)]

    def fit(self, df: DataFrame, observation: str, seq: str, order_by: Sequence[str], sample: int = 5000) -> Hmm:
        """Expectation maximisation until ``iterations`` or a gain below ``tolerance``. ``observation``: a number or an array column. Starting values come from ``sample`` rows at most."""
        require(df, observation, seq, *order_by)
        base = df.select(F.col(seq).alias("seq"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order_by)), F.col(observation).alias("x")).where("x is not null")
        rows = base.select("x").orderBy(F.xxhash64("seq", "o0")).limit(sample).collect()
        self.begin(_matrix([r.x for r in rows]))
        keep = [f"o{i}" for i in range(len(order_by))]
        lists = base.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct(*keep, "x"))).alias("l")).select(F.transform("l", lambda e: e["x"]).alias("xs")).persist()
        try:
            for _ in range(self.iterations):
                model = self

                def partial(batches: Iterator[pd.DataFrame], model: Hmm = model) -> Iterator[pd.DataFrame]:
                    total: list[np.ndarray] | None = None
                    for b in batches:
                        for xs in b["xs"]:
                            got = model.expectation(_matrix(xs))
                            total = got if total is None else [s + g for s, g in zip(total, got)]
                    if total is not None:
                        yield pd.DataFrame({"stats": [json.dumps([t.tolist() for t in total])]})

                parts = [[np.array(x) for x in json.loads(r.stats)] for r in lists.mapInPandas(partial, "stats string").collect()]
                if not parts:
                    break
                like, begun, pairs, *emission = (sum(p[i] for p in parts) for i in range(len(parts[0])))
                self.history.append(float(like[0]))
                if "s" in self.update:
                    self.start = normalized(np.maximum(self.start_prior - 1 + begun, 0))
                if "t" in self.update:
                    self.steps = normalized(np.maximum(self.step_prior - 1 + pairs, 0), axis=1)
                self.maximise(emission)
                if len(self.history) > 1 and self.history[-1] - self.history[-2] < self.tolerance:
                    break
        finally:
            lists.unpersist()
        return self

    def transform(self, df: DataFrame, observation: str, seq: str, order_by: Sequence[str], to: str = "state", how: str = "viterbi") -> DataFrame:
        """``df`` with the decoded state of each row."""
        return per_sequence(df, seq, order_by, f"{to} int", lambda g: {to: self.decode(_matrix(g[observation].tolist()), how)[1].astype("int32")})

    def score_sequences(self, df: DataFrame, observation: str, seq: str, order_by: Sequence[str]) -> DataFrame:
        """(seq, log_likelihood)."""
        kind = dict(df.dtypes)[seq]

        def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"seq": [key[0]], "log_likelihood": [self.score(_matrix(group.sort_values(list(order_by))[observation].tolist()))]})

        return df.where(F.col(observation).isNotNull()).groupBy(seq).applyInPandas(one, f"seq {kind}, log_likelihood double")


def _matrix(values) -> np.ndarray:
    x = np.array([np.atleast_1d(np.asarray(v, dtype=float)) for v in values])
    return x if len(x) else np.empty((0, 1))


class DiscreteHmm(Hmm):
    """Emissions of whole numbers from 0."""

    def __init__(self, states: int = 1, symbols: int = 2, emission: np.ndarray | None = None, **kwargs):
        super().__init__(states, **kwargs)
        self.symbols = symbols
        self.emission = emission

    def begin(self, sample: np.ndarray) -> None:
        if len(sample) and ((sample < 0).any() or (sample != np.floor(sample)).any()):
            raise ValueError("symbols are whole numbers from 0")
        if self.emission is None:
            self.emission = normalized(np.random.default_rng(self.seed).random((self.states, self.symbols)), axis=1)

    def frames(self, x: np.ndarray) -> np.ndarray:
        return log_or_never(self.emission)[:, x[:, 0].astype(int)].T

    def statistics(self, x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        out = np.zeros((self.symbols, self.states))
        np.add.at(out, x[:, 0].astype(int), p)
        return [out.T]

    def maximise(self, stats: list[np.ndarray]) -> None:
        if "e" in self.update:
            self.emission = normalized(stats[0], axis=1)

    def emit(self, state: int, random: np.random.Generator) -> int:
        return int(random.choice(self.symbols, p=self.emission[state]))


def _spread_means(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres by a few rounds of nearest-centre means from spread-out beginnings."""
    random = np.random.default_rng(seed)
    centres = [sample[random.integers(len(sample))]]
    for _ in range(k - 1):
        far = np.min([((sample - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(sample[int(far.argmax())])
    c = np.array(centres)
    for _ in range(10):
        own = ((sample[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([sample[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
    return c


class GaussianHmm(Hmm):
    """Gaussian emissions of one covariance type."""

    def __init__(self, states: int = 1, kind: str = "diag", floor: float = 1e-3, update: str = "stmc", **kwargs):
        super().__init__(states, update=update, **kwargs)
        self.kind, self.floor = kind, floor
        self.means: np.ndarray | None = None
        self.covars: np.ndarray | None = None

    def begin(self, sample: np.ndarray) -> None:
        if self.means is None:
            self.means = _spread_means(sample, self.states, self.seed)
        if self.covars is None:
            cov = np.atleast_2d(np.cov(sample.T, bias=True)) + self.floor * np.eye(sample.shape[1])
            self.covars = {"diag": np.tile(np.diag(cov), (self.states, 1)), "spherical": np.full(self.states, np.diag(cov).mean()), "tied": cov, "full": np.tile(cov, (self.states, 1, 1))}[self.kind]
        self.covars = checked_covars(self.covars, self.kind, self.states, sample.shape[1])

    def frames(self, x: np.ndarray) -> np.ndarray:
        return gaussian_log_density(x, self.means, self.covars, self.kind)

    def statistics(self, x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        return [p.sum(axis=0), p.T @ x, np.einsum("nk,ni,nj->kij", p, x, x)]

    def maximise(self, stats: list[np.ndarray]) -> None:
        n, first, second = stats
        safe = np.maximum(n, 1e-10)
        if "m" in self.update:
            self.means = first / safe[:, None]
        if "c" in self.update:
            m, d = self.means, first.shape[1]
            cross = np.einsum("ki,kj->kij", first, m)
            full = (second - cross - cross.transpose(0, 2, 1) + n[:, None, None] * np.einsum("ki,kj->kij", m, m)) / safe[:, None, None]
            full += self.floor * np.eye(d)
            diag = np.einsum("kii->ki", full)
            self.covars = {"full": full, "diag": diag, "spherical": diag.mean(axis=1), "tied": np.einsum("k,kij->ij", n / max(n.sum(), 1e-10), full)}[self.kind]

    def emit(self, state: int, random: np.random.Generator) -> np.ndarray:
        d = self.means.shape[1]
        cov = {"diag": lambda: np.diag(self.covars[state]), "spherical": lambda: np.eye(d) * self.covars[state], "tied": lambda: self.covars, "full": lambda: self.covars[state]}[self.kind]()
        return random.multivariate_normal(self.means[state], cov)


class MixtureHmm(Hmm):
    """Emissions of a mixture of Gaussians with diagonal covariances in each state; ``fixed_covars`` leaves these as they begin."""

    def __init__(self, states: int = 1, mixtures: int = 1, floor: float = 1e-3, fixed_covars: bool = False, update: str = "stmcw", **kwargs):
        super().__init__(states, update=update, **kwargs)
        self.mixtures, self.floor, self.fixed = mixtures, floor, fixed_covars
        self.weights = np.full((states, mixtures), 1 / mixtures)
        self.means: np.ndarray | None = None
        self.covars: np.ndarray | None = None

    def begin(self, sample: np.ndarray) -> None:
        k, m, d = self.states, self.mixtures, sample.shape[1]
        if self.means is None:
            centres = _spread_means(sample, k * m, self.seed)
            self.means = centres[np.lexsort(centres.T[::-1])].reshape(k, m, d)
        if self.covars is None:
            self.covars = np.tile(sample.var(axis=0) + self.floor, (k, m, 1))

    def _parts(self, x: np.ndarray) -> np.ndarray:
        k, m, d = self.means.shape
        dens = gaussian_log_density(x, self.means.reshape(k * m, d), self.covars.reshape(k * m, d))
        return dens.reshape(len(x), k, m) + log_or_never(self.weights)[None]

    def frames(self, x: np.ndarray) -> np.ndarray:
        return log_sum(self._parts(x), axis=2)

    def statistics(self, x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        parts = self._parts(x)
        share = np.exp(parts - log_sum(parts, axis=2)[:, :, None]) * p[:, :, None]
        return [share.sum(axis=0), np.einsum("nkm,nd->kmd", share, x), np.einsum("nkm,nd->kmd", share, x * x)]

    def maximise(self, stats: list[np.ndarray]) -> None:
        n, first, second = stats
        safe = np.maximum(n, 1e-10)[:, :, None]
        if "w" in self.update:
            self.weights = normalized(n, axis=1)
        if "m" in self.update:
            self.means = first / safe
        if "c" in self.update and not self.fixed:
            self.covars = np.maximum(second / safe - 2 * self.means * first / safe + self.means**2, 0) + self.floor

    def emit(self, state: int, random: np.random.Generator) -> np.ndarray:
        m = random.choice(self.mixtures, p=self.weights[state])
        return random.normal(self.means[state, m], np.sqrt(self.covars[state, m]))

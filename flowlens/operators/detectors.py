"""Anomaly detectors: isolation forest, autoencoder and hidden Markov model, fitted and applied by Spark.

The trees of the forest, each of 256 rows, are drawn from at most ``SAMPLE`` rows, taken by a hash of the id; the autoencoder is fitted on all rows in
rounds, the hidden Markov model on all windows of all hosts, many hosts at a time, whose sums Spark collects in each round. Bounds and thresholds come from all rows. A model
is applied to all rows in Arrow batches, or per host for sequences. Fitted on an empty table, a forest gives 0.5 for every row, the others 0. Its parameters are plain arrays that ``artifacts`` writes as JSON.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.features import fit_scaler
from flowlens.session import cut

SAMPLE = 20_000
SEED = 42

DETECTORS: dict[str, tuple[Callable, Callable]] = {}


def register_detector(name: str, fit: Callable, transform: Callable) -> None:
    """``fit(df, columns) -> model`` and ``transform(df, columns, model) -> df``."""
    DETECTORS[name] = (fit, transform)


def sample(rows: DataFrame, columns: list[str], key: str, bound: int = SAMPLE) -> np.ndarray:
    """The ``bound`` rows of the smallest hashes of their key, all where there are fewer; ties by key.

    Hashes are even, so those rows lie below a cut that follows from the number of rows. Only rows below it are ordered: the first of every part
    meet, about twice ``bound`` in all however many parts there are. Where too few lie below it, as where keys repeat, the cut is raised.
    """
    rows = rows.select(F.xxhash64(key).alias("_hash"), F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in columns])
    there = rows.count()
    share = 2 * bound / max(there, 1)
    while True:
        below = rows.where(F.col("_hash") < int(share * 2**64) - 2**63) if share < 1 else rows
        got = below.orderBy("_hash", "_key").limit(bound).toPandas()
        if share >= 1 or len(got) == min(bound, there):
            return got[columns].fillna(0.0).to_numpy(float)
        share *= 4


@dataclass
class IsolationForest:
    """Trees as arrays (trees, nodes): feature (-1 for a leaf), cut, and the path length a leaf stands for; children of k are 2k + 1, 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    size: int
    low: float = 0.0
    high: float = 0.0
    threshold: float = 0.7

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Minus the mean-path anomaly measure: smaller is more anomalous."""
        total, depth = np.zeros(len(x)), int(np.log2(self.feature.shape[1] + 1))
        rows = np.arange(len(x))
        for f, c, n in zip(self.feature, self.cut, self.length):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                at = f[node]
                node = np.where(at < 0, node, 2 * node + 1 + (x[rows, np.maximum(at, 0)] > c[node]))
            total += n[node]
        return -(2 ** (-total / len(self.feature) / _average_path(self.size)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Min-max scaled to 0..1 by the training range, 1 most anomalous; 0.5 if that range is empty."""
        if self.high == self.low:
            return np.full(len(x), 0.5)
        return np.clip((self.high - self.raw(x)) / (self.high - self.low), 0, 1)

    def importance(self) -> np.ndarray:
        """Share of splits by feature; equal shares without splits."""
        used = self.feature[self.feature >= 0]
        n = int(self.feature.max(initial=0)) + 1
        return np.bincount(used, minlength=n) / len(used) if len(used) else np.full(n, 1 / n)


def _average_path(n: float) -> float:
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def fit_forest(x: np.ndarray, trees: int = 100, size: int = 256, seed: int = SEED) -> IsolationForest:
    rng = np.random.default_rng(seed)
    if not len(x):
        return IsolationForest(np.full((1, 1), -1), np.zeros((1, 1)), np.ones((1, 1)), 2)
    size = min(size, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, x[rng.choice(len(x), size, replace=False)], 0)]
        while todo:
            node, part, level = todo.pop()
            span = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(x.shape[1])
            live = np.flatnonzero(span > 0)
            if level == depth or len(part) <= 1 or not len(live):
                length[t, node] = level + _average_path(len(part))
                continue
            f = rng.choice(live)
            feature[t, node], cut[t, node] = f, part[:, f].min() + rng.random() * span[f]
            right = part[:, f] > cut[t, node]
            todo += [(2 * node + 1, part[~right], level + 1), (2 * node + 2, part[right], level + 1)]
    model = IsolationForest(feature, cut, length, size)
    raw = model.raw(x)
    model.low, model.high = float(raw.min()), float(raw.max())
    return model


@dataclass
class Autoencoder:
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    mean: np.ndarray
    sd: np.ndarray
    threshold: float = 0.0

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = layers[-1] @ w + b
            layers.append(z if k + 1 == len(self.weights) else np.maximum(z, 0))
        return layers

    def error(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.sd
        return ((self._forward(z)[-1] - z) ** 2).mean(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Error over twice the threshold, at most 1; 0 with a threshold of 0."""
        return np.minimum(1.0, self.error(x) / (2 * self.threshold)) if self.threshold > 0 else np.zeros(len(x))


#: Layers between input and output, rows of a step, and the rate of Adam.
HIDDEN, STEP_ROWS, RATE = (64, 32, 16, 32, 64), 32, 1e-3
#: Rounds over all rows; in each, every part of the rows goes on from the same parameters and their means are the next ones.
#: A part with few rows passes over them again until it has taken so many steps in a round.
ROUNDS, LEAST_STEPS = 20, 300


def _fresh(mean: np.ndarray, sd: np.ndarray, hidden: tuple[int, ...], rng: np.random.Generator) -> Autoencoder:
    sizes = [len(mean), *hidden, len(mean)]
    return Autoencoder([rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]], mean, np.where(sd > 0, sd, 1.0))


class Adam:
    """Steps on the squared error of a model's parameters, with their moments."""

    def __init__(self, model: Autoencoder, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in self.parameters], [np.zeros_like(p) for p in self.parameters]

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.model.weights, *self.model.biases]

    def step(self, part: np.ndarray) -> None:
        model = self.model
        layers = model._forward(part)
        delta, gw, gb = 2 * (layers[-1] - part) / part.size, [], []
        for k in range(len(model.weights) - 1, -1, -1):
            gw.insert(0, layers[k].T @ delta)
            gb.insert(0, delta.sum(axis=0))
            if k:
                delta = (delta @ model.weights[k].T) * (layers[k] > 0)
        self.t += 1
        for p, g, mk, vk in zip(self.parameters, [*gw, *gb], self.m, self.v):
            mk += 0.1 * (g - mk)
            vk += 0.001 * (g * g - vk)
            p -= self.rate * (mk / (1 - 0.9**self.t)) / (np.sqrt(vk / (1 - 0.999**self.t)) + 1e-8)


def fit_autoencoder(x: np.ndarray, hidden: tuple[int, ...] = HIDDEN, epochs: int = 50, batch: int = STEP_ROWS, rate: float = RATE, seed: int = SEED) -> Autoencoder:
    """Adam on the squared error over rows that fit in memory; the threshold is the 99th percentile of the training error."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return Autoencoder([np.zeros((x.shape[1], x.shape[1]))], [np.zeros(x.shape[1])], np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model = _fresh(x.mean(axis=0), x.std(axis=0), hidden, rng)
    z, adam = (x - model.mean) / model.sd, Adam(model, rate)
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(z), batch):
            adam.step(z[order[a : a + batch]])
    model.threshold = float(np.percentile(model.error(x), 99))
    return model


def fit_autoencoder_rows(rows: DataFrame, columns: list[str], hidden: tuple[int, ...] = HIDDEN, rounds: int = ROUNDS, batch: int = STEP_ROWS, rate: float = RATE, seed: int = SEED) -> Autoencoder:
    """The autoencoder of all rows, in synchronous rounds; its threshold is left to ``calibrated``.

    Mean and deviation come from one aggregation. In a round every part of the rows, in Arrow batches, takes Adam's steps from the parameters that the
    round began with, several times over where its rows are few; Spark sums the parameters that the parts end with, by their rows, and the means begin the next round. What goes back and
    forth has the size of the model, whatever the rows; moments are kept by the parts' rounds, not across them. The rows are checkpointed, so parts
    stay the same in every round and after a lost executor.
    """
    rows = cut(rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]))
    scaler = fit_scaler(rows, tuple(columns))
    mean, sd = (np.array([scaler[c][k] for c in columns], float) for k in (0, 1))
    if rows.isEmpty():
        return fit_autoencoder(np.zeros((0, len(columns))))
    model = _fresh(mean, sd, hidden, np.random.default_rng(seed))
    shapes = [p.shape for p in Adam(model, rate).parameters]
    for number in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, rng, seen = copy.deepcopy(shared.value), np.random.default_rng(seed + number), 0  # noqa: B023
            adam, held = Adam(own, rate), []

            def descend_once(z: np.ndarray) -> None:
                order = rng.permutation(len(z))
                for a in range(0, len(z), batch):
                    adam.step(z[order[a : a + batch]])

            for pdf in batches:
                z = (pdf.to_numpy(float) - own.mean) / own.sd
                descend_once(z)
                seen += len(z)
                held = [*held, z] if seen <= LEAST_STEPS * batch else []
            while held and adam.t < LEAST_STEPS:
                descend_once(np.concatenate(held))
            if seen:
                flat = np.concatenate([p.ravel() for p in adam.parameters])
                yield pd.DataFrame({"place": np.arange(len(flat), dtype=np.int32), "total": flat * seen, "n": seen})

        made = rows.mapInPandas(descend, "place int, total double, n long").groupBy("place").agg((F.sum("total") / F.sum("n")).alias("v")).toPandas()
        flat, at = made.sort_values("place")["v"].to_numpy(float), 0
        parameters = []
        for shape in shapes:
            parameters.append(flat[at : at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))
        half = len(parameters) // 2
        model = Autoencoder(parameters[:half], parameters[half:], model.mean, model.sd)
        shared.unpersist()
    return model


#: Names of the states, and what a window in each scores at least.
STATE_LABELS = ("normal", "scan", "exfil", "c2")
STATE_BASE = {"normal": 0.1, "scan": 0.6, "exfil": 0.8, "c2": 0.7, "unknown": 0.5}


@dataclass
class Hmm:
    """A Gaussian model with diagonal covariances, on standardized features."""

    start: np.ndarray
    step: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    labels: list[str]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.spread
        return -0.5 * (((z[:, None] - self.means) ** 2 / self.variances).sum(2) + np.log(2 * np.pi * self.variances).sum(1))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """The likeliest states of a sequence and its log-likelihood."""
        return self.decode_all([x])[0]

    def decode_all(self, sequences: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        """The same of each of several, all of which take a step in time at once."""
        step, got = np.log(self.step + 1e-300), [(np.zeros(0, int), 0.0)] * len(sequences)
        for part, n, x in _ranked(sequences):
            alive, begin = _alive(n)
            e, back, last = self.emissions(x), np.zeros((len(x), len(self.start)), int), np.zeros(len(part), int)
            best = forward = np.log(self.start + 1e-300) + e[: alive[0]]
            likely, path = np.zeros(len(part)), np.zeros(len(x), int)
            for t in range(len(alive)):
                here = slice(begin[t], begin[t + 1])
                if t:
                    options = best[: alive[t], :, None] + step
                    back[here], best = options.argmax(1), options.max(1) + e[here]
                    forward = np.logaddexp.reduce(forward[: alive[t], :, None] + step, axis=1) + e[here]
                on = alive[t + 1] if t + 1 < len(alive) else 0  # the others end here
                last[on : alive[t]], likely[on : alive[t]] = best[on:].argmax(1), np.logaddexp.reduce(forward[on:], axis=1)
            state = last
            for t in range(len(alive) - 1, -1, -1):
                here = slice(begin[t], begin[t + 1])
                path[here] = state[: alive[t]]
                if t:
                    state = np.concatenate([back[here][np.arange(alive[t]), state[: alive[t]]], last[alive[t] : alive[t - 1]]])
            for k, place in enumerate(part):
                got[place] = (path[begin[: n[k]] + k], float(likely[k]))
        return got


def label_states(means: np.ndarray, columns: list[str]) -> list[str]:
    """Greedy, in this order: the state of most bytes out is "exfil", of the others the one of most destinations "scan", the one of least bytes
    and destinations (a destination weighs as 1,000 bytes) "normal", the last "c2"."""
    sent, met = (means[:, columns.index(c)] if c in columns else np.zeros(len(means)) for c in ("bytes_out", "unique_destinations"))
    worth = {"exfil": sent, "scan": met, "normal": -sent - 1000 * met, "c2": np.zeros(len(means))}
    left, labels = list(range(len(means))), ["unknown"] * len(means)
    for label, value in worth.items():
        if left:
            pick = max(left, key=lambda k: (value[k], -k))
            labels[pick] = label
            left.remove(pick)
    return labels


#: Windows that are held at once, with what is computed for them.
TOGETHER = 200_000


def _ranked(sequences: list[np.ndarray], most: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences side by side, for a step in time of all of them at once: their places in the list, the longest first, and lengths, and their rows.

    The rows are in order of time, then of that order, so that those of a time are one run, of as many sequences as are so long.
    """
    lengths = np.array([len(s) for s in sequences], int)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order) and lengths[order[at]]:
        to = at + max(1, most // int(lengths[order[at]]))
        part = order[at:to]
        part, at = part[lengths[part] > 0], to
        n = lengths[part]
        t = np.concatenate([np.arange(k) for k in n])
        yield part, n, np.concatenate([sequences[k] for k in part])[np.argsort(t, kind="stable")]


def _alive(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in falling order: how many sequences have a window at each time, and where those of a time begin."""
    alive = np.searchsorted(-n, -np.arange(n[0]), side="left")
    return alive, np.concatenate([[0], np.cumsum(alive)])


def _expected(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Sums of the sequences' expectations, flat: starts, steps, and for each state its weight, its features and their squares (standardized)."""
    states, width = model.means.shape
    total = np.zeros(states + states * states + states + 2 * states * width)
    for _, n, x in _ranked(sequences):
        alive, begin = _alive(n)
        z, e = (x - model.center) / model.spread, model.emissions(x)
        p = np.exp(e - e.max(1, keepdims=True))
        forward, scale, step = np.zeros_like(p), np.zeros((len(p), 1)), np.zeros((states, states))
        state = model.start * p[: alive[0]]
        for t in range(len(alive)):
            here = slice(begin[t], begin[t + 1])
            state = (state[: alive[t]] @ model.step) * p[here] if t else state
            sums = state.sum(1, keepdims=True)
            scale[here] = np.where(sums > 0, sums, 1e-300)
            state = forward[here] = state / scale[here]
        beta, gamma = np.ones((0, states)), np.zeros_like(p)
        for t in range(len(alive) - 1, -1, -1):
            here = slice(begin[t], begin[t + 1])
            beta = np.concatenate([beta, np.ones((alive[t] - len(beta), states))])  # of sequences that end here
            made = forward[here] * beta
            sums = made.sum(1, keepdims=True)
            gamma[here] = made / np.where(sums > 0, sums, 1e-300)
            if t:
                ahead = p[here] * beta
                past = forward[begin[t - 1] : begin[t - 1] + alive[t]]
                # Each pair's expectations sum to 1; the sum of a pair is past @ step . ahead.
                sums = ((past @ model.step) * ahead).sum(1, keepdims=True)
                step += (past / np.where(sums > 0, sums, 1e-300)).T @ ahead
                beta = ahead @ model.step.T / scale[here]
        total += np.concatenate([gamma[: alive[0]].sum(0), (step * model.step).ravel(), gamma.sum(0), (gamma.T @ z).ravel(), (gamma.T @ z**2).ravel()])
    return total


def _improved(model: Hmm, sums: np.ndarray) -> Hmm:
    states, width = model.means.shape
    start, step, mass, first, second = np.split(sums, np.cumsum([states, states * states, states, states * width]))
    step, mass = step.reshape(states, states) + 1e-3, mass[:, None] + 1e-9
    means = first.reshape(states, width) / mass
    return Hmm(start / start.sum(), step / step.sum(1, keepdims=True), means, np.maximum(1e-3, second.reshape(states, width) / mass - means**2), model.center, model.spread, [])


def _first_guess(means: np.ndarray, center: np.ndarray, spread: np.ndarray, seed: int) -> Hmm:
    """States with the given means, standardized and set apart a little; a state lasts."""
    states = len(means)
    means = (means - center) / spread + np.random.default_rng(seed).normal(0, 1e-3, means.shape)
    return Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1)), means, np.ones_like(means), center, spread, [])


def _named(model: Hmm, columns: list[str]) -> Hmm:
    model.labels = label_states(model.means * model.spread + model.center, columns)
    return model


def fit_hmm(sequences: list[np.ndarray], columns: list[str], states: int = 4, rounds: int = 20, seed: int = SEED) -> Hmm | None:
    """Baum-Welch over sequences of at least two windows; none below ``states`` windows in all."""
    sequences = [s for s in sequences if len(s) >= 2]
    if sum(map(len, sequences)) < states:
        return None
    x = np.concatenate(sequences)
    center, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    # The first states are equal parts of the windows in order of the sum of their standardized features.
    order = np.argsort(((x - center) / spread).sum(1), kind="stable")
    model = _first_guess(np.array([x[part].mean(0) for part in np.array_split(order, states)]), center, spread, seed)
    for _ in range(rounds):
        model = _improved(model, _expected(model, sequences))
    return _named(model, columns)


def fit_hmm_windows(windows: DataFrame, columns: list[str], key: str = "src_ip", order: str = "window_us", states: int = 4, rounds: int = 20, seed: int = SEED) -> Hmm | None:
    """The same over all windows of a table. Each round a task sums the expectations of its hosts and Spark sums those of the tasks.

    A host's windows are one sequence; there are as many as the time span has windows, however many flows they sum up.
    """
    rows = windows.select(key, order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    several = rows.groupBy(key).count().where("count >= 2").select(key)
    held = rows.join(several, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("s")).select(F.transform("s", lambda w: F.array(*[w[c] for c in columns])).alias("x")).persist()
    flat = held.select(F.explode("x").alias("w"))
    every = range(len(columns))
    got = flat.agg(F.count("*").alias("n"), *[f(F.col("w")[k]).alias(f"{name}{k}") for k in every for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if got["n"] < states:
        held.unpersist()
        return None
    center, spread = (np.array([got[f"{name}{k}"] for k in every], float) for name in "ms")
    spread = np.where(spread > 0, spread, 1.0)
    # The first states are about equal parts of the windows in order of the sum of their standardized features.
    total = sum(((F.col("w")[k] - float(center[k])) / float(spread[k]) for k in every), F.lit(0.0))
    cuts = flat.agg(F.percentile_approx(total, [k / states for k in range(1, states)])).first()[0]
    part = sum(((total > c).cast("int") for c in cuts), F.lit(0))
    sums_of = {r["part"]: r for r in flat.groupBy(part.alias("part")).agg(*[F.avg(F.col("w")[k]).alias(f"m{k}") for k in every]).collect()}
    first = _first_guess(np.array([[sums_of[s][f"m{k}"] for k in every] if s in sums_of else center for s in range(states)], float), center, spread, seed)
    try:
        model = _fitted(held, first, rounds)
    except ArithmeticError:  # sums that are no numbers: once more, with fewer rounds
        model = _fitted(held, first, min(rounds, RETRY_ROUNDS))
    finally:
        held.unpersist()
    return _named(model, columns)


#: Rounds of a fit that is tried again after one that failed.
RETRY_ROUNDS = 10


def _fitted(held: DataFrame, model: Hmm, rounds: int) -> Hmm:
    """Rounds of expectation, summed by Spark, and maximization; ArithmeticError where parameters cease to be numbers."""
    for _ in range(rounds):
        now, width = model, len(model.center)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                made = _expected(now, [x.reshape(-1, width) for x in pdf["x"]])
                total = made if total is None else total + made
            if total is not None:
                yield pd.DataFrame({"place": np.arange(len(total)), "v": total})

        parts = held.select(F.flatten("x").alias("x")).mapInPandas(sums, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()
        model = _improved(model, np.array([r["v"] for r in parts]))
        if not all(np.isfinite(x).all() for x in (model.start, model.step, model.means, model.variances)):
            raise ArithmeticError("the fit has come to parameters that are no numbers")
    return model


def calibrated(rows: DataFrame, columns: list[str], model):
    """The model with the bounds of its scores (a forest) or its threshold (an autoencoder) taken from all rows, in one aggregation."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def measure(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shared.value
        for part in parts:
            x = np.column_stack([c.fillna(0.0).to_numpy(float) for c in part])
            yield pd.Series(m.error(x) if isinstance(m, Autoencoder) else m.raw(x))

    value = rows.select(measure(*[F.col(c).cast("double") for c in columns]).alias("v"))
    got = value.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", 0.99).alias("p99")).first()
    shared.unpersist()
    if got["low"] is not None and isinstance(model, Autoencoder):
        model.threshold = float(got["p99"])
    elif got["low"] is not None:
        model.low, model.high = float(got["low"]), float(got["high"])
    return model


def score_rows(rows: DataFrame, columns: list[str], model, key: str, name: str) -> DataFrame:
    """(key, model_name, score, is_anomaly) of every row; the model is broadcast, its size is fixed by its parameters."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.column_stack([c.fillna(0.0).to_numpy(float) for c in part])
            yield pd.Series(shared.value.score(x))

    scored = rows.select(key, score(*[F.col(c).cast("double") for c in columns]).alias("score"))
    # An autoencoder's error above its threshold is a score above one half.
    limit = 0.5 if isinstance(model, Autoencoder) else model.threshold
    return scored.select(key, F.lit(name).alias("model_name"), "score", (F.col("score") > limit).alias("is_anomaly"))


def score_sequences(windows: DataFrame, columns: list[str], model: Hmm | None, key: str = "src_ip", order: str = "window_us") -> DataFrame:
    """(key, window, state_label, score, is_anomaly) per window: base by state plus a part of the sequence's unlikeliness.

    A host's windows are decoded as one sequence, whose length is the number of windows in the time span. Without a model all are unknown, 0.
    """
    rows = windows.select(F.col(key).cast("long").alias(key), order, *columns)
    if model is None:
        return rows.select(key, order, F.lit("unknown").alias("state_label"), F.lit(0.0).alias("score"), F.lit(False).alias("is_anomaly"))
    shared = windows.sparkSession.sparkContext.broadcast(model)
    schema = f"{key} long, {order} long, state_label string, score double, is_anomaly boolean"

    value = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).isNull().alias("_none"), F.col(order).cast("long").alias(order), *value))).alias("s"))
    held = held.select(key, F.transform("s", lambda w: w[order]).alias("at"), F.flatten(F.transform("s", lambda w: F.array(*[w[c] for c in columns]))).alias("x"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        base = np.array([STATE_BASE.get(v, 0.5) for v in m.labels])
        for pdf in batches:
            found = m.decode_all([x.reshape(-1, len(columns)) for x in pdf["x"]])
            n = [len(path) for path, _ in found]
            path, likelihood = np.concatenate([p for p, _ in found] or [np.zeros(0, int)]), np.repeat([v for _, v in found], n)
            labels = np.array(m.labels, object)[path]
            score = np.clip(base[path] + np.clip(-likelihood / 100, 0, 0.2), 0, 1)
            yield pd.DataFrame({key: pdf[key].astype("Int64").repeat(n).array, order: pd.array(np.concatenate(list(pdf["at"]) or [[]]), dtype="Int64"), "state_label": labels, "score": score, "is_anomaly": (score > 0.5) | (labels != "normal")})

    return held.mapInPandas(decode, schema)


def artifact(model) -> str:
    """The parameters as JSON."""
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else [plain(x) for x in v] if isinstance(v, list) else v
    return json.dumps({"kind": type(model).__name__, **{k: plain(v) for k, v in asdict(model).items()}})


def from_artifact(text: str):
    fields = json.loads(text)
    kind = {c.__name__: c for c in (IsolationForest, Autoencoder, Hmm)}[fields.pop("kind")]
    arrays = {k: [np.array(x) for x in v] if k in ("weights", "biases") else np.array(v) if isinstance(v, list) and k != "labels" else v for k, v in fields.items()}
    return kind(**arrays)


register_detector("isolation_forest", lambda rows, columns, key: calibrated(rows, columns, fit_forest(sample(rows, columns, key))), lambda rows, columns, model, key: score_rows(rows, columns, model, key, "isolation_forest"))
register_detector("autoencoder", lambda rows, columns, key: calibrated(rows, columns, fit_autoencoder_rows(rows, columns)), lambda rows, columns, model, key: score_rows(rows, columns, model, key, "autoencoder"))


def detect(rows: DataFrame, columns: list[str], key: str, names: tuple[str, ...] = ("isolation_forest", "autoencoder"), windows: DataFrame | None = None, window_columns: list[str] | None = None) -> DataFrame:
    """Fits and applies the named detectors; their results (key, model_name, score, is_anomaly) one below the other.

    With ``windows`` (src_ip, window_us and ``window_columns``) the hidden Markov model is one of them; keys are text then, its own "source@start".
    """
    out = None
    for name in names:
        fit, transform = DETECTORS[name]
        part = transform(rows, columns, fit(rows, columns, key), key)
        part = part if windows is None else part.withColumn(key, F.col(key).cast("string"))
        out = part if out is None else out.unionByName(part)
    if windows is not None:
        found = score_sequences(windows, window_columns, fit_hmm_windows(windows, window_columns))
        part = found.select(F.concat_ws("@", "src_ip", "window_us").alias(key), F.lit("hmm").alias("model_name"), "score", "is_anomaly")
        out = part if out is None else out.unionByName(part)
    return out


def training_summary(results: DataFrame) -> DataFrame:
    """Rows scored, anomalies and mean score of each model."""
    return results.groupBy("model_name").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"), F.avg("score").alias("mean_score"))

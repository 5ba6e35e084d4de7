"""A binary head over feature vectors, trained by AdamW on gradients that are summed on the executors.

Each epoch is one scan: every task sums the gradient of its rows, and only these sums
(one number a feature) reach the driver. Epochs are judged by the AUC of held-out
patients; training stops when it has not improved for a while, and the best weights are
kept. Weights, moments and the best epoch are stored after each epoch, whole or not at
all, so that an interrupted run goes on and ends with the same result; a folder keeps to
one set of settings.

Defined cases: rows without vector, label or patient don't count; rows of one class
or none to train on are an error, and so are vectors of different lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import metrics as M
from tessella.operators.scoring import score
from tessella.sources import shared, sinks
from tessella.streaming.commits import lock_settings


@dataclass(frozen=True)
class Fit:
    """Settings of a run."""

    epochs: int = 30
    rate: float = 0.05
    decay: float = 0.01
    patience: int = 6
    min_delta: float = 1e-4
    balanced: bool = True
    seed: int = 42


class AdamW:
    """Adam with decoupled weight decay; the last weight, the bias, does not decay."""

    def __init__(self, size: int, rate: float, decay: float):
        self.rate, self.decay = rate, np.append(np.full(size - 1, decay), 0.0)
        self.first, self.second, self.step = np.zeros(size), np.zeros(size), 0

    def update(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        mean, spread = self.first / (1 - 0.9**self.step), self.second / (1 - 0.999**self.step)
        return weights * (1 - self.rate * self.decay) - self.rate * mean / (np.sqrt(spread) + 1e-8)


def _sums(rows: DataFrame, of) -> np.ndarray:
    """The sum of `of(matrix, labels)`, a vector, over all rows, added up on the executors."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = of(np.stack(batch["v"].to_list()).astype(np.float64), batch["y"].to_numpy(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

    found = rows.select("v", "y").mapInPandas(work, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r.s for r in found])


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and deviation of each feature, and rows of class 0 per row of class 1."""
    sums = _sums(rows, lambda x, y: np.concatenate([x.sum(axis=0), (x**2).sum(axis=0), [len(y), y.sum()]]))
    if not len(sums) or not 0 < sums[-1] < sums[-2]:
        raise ValueError("both classes are needed to train on")
    size, n, positive = (len(sums) - 2) // 2, sums[-2], sums[-1]
    mean = sums[:size] / n
    return mean, np.sqrt(np.maximum(sums[size : 2 * size] / n - mean**2, 1e-12)), (n - positive) / positive


def _gradient(weights: np.ndarray, mean: np.ndarray, deviation: np.ndarray, weight: float):
    """Of a batch: the gradient of the weighted cross entropy, the loss and the weight of its rows."""
    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
        logit = np.clip(z @ weights, -30, 30)
        p, w = 1 / (1 + np.exp(-logit)), np.where(y == 1, weight, 1.0)
        loss = np.where(y == 1, np.log1p(np.exp(-logit)), np.log1p(np.exp(logit)))
        return np.concatenate([z.T @ (w * (p - y)), [(w * loss).sum(), w.sum()]])

    return of


def head_scores(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, deviation: np.ndarray, vector: str = "v") -> DataFrame:
    """`rows` with y_prob by a trained head."""
    return score(rows, lambda: lambda m: 1 / (1 + np.exp(-np.clip((m - mean) / deviation @ weights[:-1] + weights[-1], -30, 30))), vector)


def train_head(train: DataFrame, held: DataFrame, vector: str, label: str, patient: str, folder: str, fit: Fit | None = None) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """The best head (weights, mean, deviation) and the history (epoch, loss, auc, best).

    `folder` is where the run is stored. Both frames are read once an epoch.
    """
    fit = fit or Fit()
    lock_settings(folder, asdict(fit))
    frames = [f.select(F.col(vector).alias("v"), F.col(label).cast("int").alias("y"), F.col(patient).alias("patient")).filter("v IS NOT NULL AND y IN (0, 1) AND patient IS NOT NULL") for f in (train, held)]
    state_at = shared.joined(folder, "state.npz")
    if shared.exists(state_at):
        state = sinks.get_arrays(state_at)
    else:
        mean, deviation, ratio = _moments(frames[0])
        start = np.append(np.random.default_rng(fit.seed).normal(0, 0.01, len(mean)), 0.0)
        state = {"mean": mean, "deviation": deviation, "ratio": np.array(ratio if fit.balanced else 1.0), "weights": start, "best": start, "first": np.zeros_like(start), "second": np.zeros_like(start), "history": np.zeros((0, 4))}
    optimiser = AdamW(len(state["weights"]), fit.rate, fit.decay)
    optimiser.first, optimiser.second, optimiser.step = state["first"], state["second"], len(state["history"])
    while len(state["history"]) < fit.epochs:
        history = state["history"]
        best_auc, best_epoch = (history[-1, 3], int(history[np.flatnonzero(history[:, 2] == history[-1, 3])[0], 0])) if len(history) else (-1.0, 0)
        if len(history) - best_epoch >= fit.patience:
            break
        sums = _sums(frames[0], _gradient(state["weights"], state["mean"], state["deviation"], float(state["ratio"])))
        weights = optimiser.update(state["weights"], sums[:-2] / sums[-1])
        pooled = M.mean_pool(head_scores(frames[1], weights, state["mean"], state["deviation"]), ["patient"]).join(M.patient_labels(frames[1], "patient", "y"), "patient")
        auc = M.auc(pooled.withColumn("all", F.lit(0)), ["all"], "y_true", "y_prob").first()
        auc = float(auc["auc"]) if auc is not None and auc["auc"] is not None else 0.5
        better = auc > best_auc + fit.min_delta
        row = [len(history) + 1, sums[-2] / sums[-1], auc, auc if better else best_auc]
        state = state | {"weights": weights, "best": weights if better else state["best"], "first": optimiser.first, "second": optimiser.second, "history": np.vstack([history, row])}
        sinks.put_arrays(state_at, **state)
    return {"weights": state["best"], "mean": state["mean"], "deviation": state["deviation"]}, [(int(e), float(loss), float(a), float(b)) for e, loss, a, b in state["history"]]

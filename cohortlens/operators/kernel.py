"""Kernel machines on any number of rows: Nystroem features of landmarks, all machines fitted by scans of the cohort.

A training set's landmarks are LANDMARKS of its own rows at most, the first in the cohort's seeded order. A row's
features are its kernel values with them, turned by the inverse root of the landmarks' own kernel matrix, so that inner
products of features stand for the kernel. On these features each pair of classes has a linear machine with squared
hinge loss, fitted by Newton steps of all machines at once; its margins on training rows give a logistic curve, and
the curves of all pairs are coupled by their mean. With as many landmarks as rows this is the machine itself.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from cohortlens.operators import glm

LANDMARKS = 128


class KernelModels:
    """Machines of (training set, C, gamma) on one cohort, for each pair of classes; gamma is a number, scale or auto."""

    def __init__(self, cohort: glm.Cohort, names: list[tuple[tuple[int, int], float, object]], landmarks: int = LANDMARKS):
        self.cohort, self.names = cohort, list(dict.fromkeys(names))
        self.pairs = list(combinations(range(len(cohort.classes)), 2))
        self.gamma, self.marks, self.turn = {}, {}, {}
        rows = cohort.table.select("cls", "rank", "x").orderBy("rank", "cls").limit(8 * landmarks).collect()
        x, cls, rank = np.array([[np.nan if v is None else v for v in r["x"]] for r in rows], float), np.array([r["cls"] for r in rows]), np.array([r["rank"] for r in rows])
        shared = glm.shared_vectors(x, cohort.centre, cohort.scale, cohort.missing)
        for s in {n[0] for n in self.names}:
            own = np.flatnonzero(cohort.folds.training(s, cls, rank))[:landmarks]
            self.marks[s] = shared[own] @ cohort.maps[s][:, :-1]
        for name in self.names:
            s, _, kind = name
            live = (np.abs(cohort.maps[s][:, :-1]).sum(0) > 0).sum() or 1
            self.gamma[s, kind] = {"scale": 1 / live, "auto": 1 / cohort.features}.get(kind, kind)
        for s, kind in self.gamma:
            values, vectors = np.linalg.eigh(kernel(self.marks[s], self.marks[s], self.gamma[s, kind]))
            keep = values > 1e-10 * values.max()
            self.turn[s, kind] = vectors[:, keep] / np.sqrt(values[keep])
        # Machines that differ in the name of an equal gamma are fitted once.
        self.as_ = {}
        for s, C, kind in self.names:
            first = next(k for t, k in self.gamma if t == s and self.gamma[s, k] == self.gamma[s, kind])
            self.as_[s, C, kind] = (s, C, first)
        distinct = list(dict.fromkeys(self.as_.values()))
        width = max(t.shape[1] for t in self.turn.values()) + 1
        wave = max(1, glm.WAVE_BYTES // (8 * width * width))
        todo = [(*n, p) for n in distinct for p in self.pairs]
        self.coef: dict = {}
        self.curve: dict = {}
        for a in range(0, len(todo), wave):
            self.coef |= self._newton(todo[a : a + wave], width, self._hinge)
            self.curve |= self._newton(todo[a : a + wave], 2, self._logistic)

    def _newton(self, names: list, width: int, loss) -> dict:
        weight = (lambda n: n[1]) if loss == self._hinge else (lambda n: 1.0)
        return glm.newton(names, 1, width, weight, lambda todo, trial: self._sums(todo, trial, width, loss))[0]

    @staticmethod
    def _hinge(b, t, w, coef):
        """Loss, slopes and curvatures of squared hinges."""
        short = np.maximum(0.0, 1 - t * (b @ coef))
        return (w * short**2).sum(), -2 * w * t * short, 2.0 * w * (short > 0)

    @staticmethod
    def _logistic(b, t, w, coef):
        z = t * (b @ coef)
        p = 1 / (1 + np.exp(np.clip(z, -700, 700)))
        return (w * np.logaddexp(0, -z)).sum(), -w * t * p, w * p * (1 - p)

    def _sums(self, todo: list, trial: dict, width: int, loss) -> dict:
        c, by = self.cohort, {}
        for i, n in enumerate(todo):
            by.setdefault((n[0], n[2]), []).append(i)
        features, curve, weights = self._features, loss == self._logistic, c.weights
        machines = {n: self.coef[n][0] for n in todo} if curve else {}
        full = max(t.shape[1] for t in self.turn.values()) + 1
        deal, centre, scale, missing = c.folds, c.centre, c.scale, c.missing

        def run(x, cls, rank):
            a, out = glm.shared_vectors(x, centre, scale, missing), {}
            for (s, kind), members in by.items():
                rows = deal.training(s, cls, rank)
                phi, y = features(a[rows], s, kind, full), cls[rows]
                for i in members:
                    low, high = todo[i][3]
                    some = (y == low) | (y == high)
                    b, t = phi[some], np.where(y[some] == high, 1.0, -1.0)
                    if curve:
                        b = np.c_[b @ machines[todo[i]], np.ones(len(b))]
                    both = weights[s][[low, high]]
                    if curve:  # classes of the pair are balanced among themselves
                        both = (1 / both).sum() * both / 2
                    w = np.where(t > 0, both[1], both[0])
                    value, slope, bend = loss(b, t, w, trial[todo[i]][0])
                    out[i] = np.concatenate([[value], b.T @ slope, ((b * bend[:, None]).T @ b).ravel()])
            return out

        got = glm.table_sums(c.table, c.width, run)
        return {n: (got[i][0], got[i][1 : 1 + width].reshape(1, width), got[i][1 + width :].reshape(1, 1, width, width)) for i, n in enumerate(todo)}

    @property
    def _features(self):
        """Rows of shared vectors as features of a training set, padded with zeros before the last one, which is 1."""
        maps, marks, turn, gamma = self.cohort.maps, self.marks, self.turn, self.gamma

        def run(a: np.ndarray, s, kind, width: int) -> np.ndarray:
            phi = kernel(a @ maps[s][:, :-1], marks[s], gamma[s, kind]) @ turn[s, kind]
            return np.c_[phi, np.zeros((len(a), width - 1 - phi.shape[1])), np.ones(len(a))]

        return run

    def scorer(self, name):
        """A function from shared vectors to the probabilities of the classes."""
        s, C, kind = self.as_[name]
        features, full, k = self._features, max(t.shape[1] for t in self.turn.values()) + 1, len(self.cohort.classes)
        own = [(p, self.coef[s, C, kind, p][0], self.curve[s, C, kind, p][0]) for p in self.pairs]

        def run(a: np.ndarray) -> np.ndarray:
            phi, out = features(a, s, kind, full), np.zeros((len(a), k))
            for (low, high), machine, (slope, base) in own:
                p = 1 / (1 + np.exp(-np.clip(slope * (phi @ machine) + base, -700, 700)))
                out[:, low] += 1 - p
                out[:, high] += p
            return out / out.sum(1, keepdims=True)

        return run


def kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0.0, (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T))

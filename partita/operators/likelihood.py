"""The model's numbers for one partition: as many as there are clusters times attributes, whatever the number of units.

Tasks get them the way they get the centres in k-means: units go by, and their scores are sums over their own ones.
Changes of a partition are scored from the counts of what moves alone; clusters that are not touched keep their terms
but for the priors, which depend on the number of clusters only.
"""

from __future__ import annotations

import math

import numpy as np

from partita.functions.special import SHIFT, STIRLING, log_of
from partita.operators.model import class_priors


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0, as ``special.lgamma`` says it in columns."""
    x = np.asarray(x, float)
    y = x + SHIFT
    square, series, product = 1 / (y * y), np.full_like(y, STIRLING[-1]), x.copy()
    for c in reversed(STIRLING[:-1]):
        series = series * square + c
    for k in range(1, SHIFT):
        product = product * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series / y - np.log(product)


class Model:
    """Counts of a partition (n by cluster, n1 by cluster and attribute) under hyper-parameters a, b (by state)."""

    def __init__(self, n: np.ndarray, n1: np.ndarray, a: np.ndarray, b: np.ndarray, g: tuple[float, float, float]):
        self.n, self.n1, self.a, self.b, self.logs = n.astype(np.int64), n1.astype(np.int64), a, b, np.array(class_priors(g))
        self.k, self.m = n1.shape
        self._norm = lgamma(a + b) - lgamma(a) - lgamma(b)
        self.parts = self._marginals(self.n, self.n1)
        self._strong_sums: dict[int, np.ndarray] = {}
        self._kind: np.ndarray | None = None

    def _marginals(self, n: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """Log marginals by state, cluster and attribute."""
        a, b, n = self.a[:, None], self.b[:, None], n[:, None]
        return self._norm[:, None] + lgamma(a + n1) + lgamma(b + n - n1) - lgamma(a + b + n)

    @staticmethod
    def _state_logs(k: int) -> tuple[float, float]:
        """Log probabilities of states 3 and 4 with k clusters."""
        return log_of((k - 1) / k), -math.log(k)

    def _strong(self, parts: np.ndarray, k: int) -> np.ndarray:
        third, fourth = self._state_logs(k)
        return np.maximum(parts[2] + third, parts[3] + fourth)

    def _total(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> tuple[float, np.ndarray]:
        h1, h2, h3 = h1 + self.logs[0], h2 + self.logs[1], h3 + self.logs[2]
        kind = np.where((h3 > h2) & (h3 > h1), 3, np.where(h3 > h2, 1, np.where(h2 > h1, 2, 1)))
        return float(np.where(kind == 3, h3, np.where(kind == 2, h2, h1)).sum()), kind

    def _strong_sum(self, k: int) -> np.ndarray:
        if k not in self._strong_sums:
            self._strong_sums[k] = self._strong(self.parts, k).sum(0)
        return self._strong_sums[k]

    def score(self) -> float:
        return self._total(self.parts[0].sum(0), self.parts[1].sum(0), self._strong_sum(self.k))[0]

    def states(self) -> np.ndarray:
        """By cluster and attribute: the class of the attribute, or 4 where its value is characteristic."""
        _, kind = self._total(self.parts[0].sum(0), self.parts[1].sum(0), self._strong_sum(self.k))
        third, fourth = self._state_logs(self.k)
        return np.where((kind == 3) & (self.parts[3] + fourth > self.parts[2] + third), 4, kind)

    def rescored(self, changes: dict[int, tuple[int, np.ndarray]]) -> tuple[float, int]:
        """Score and number of clusters once clusters have gained (or lost) so many units and ones.

        Only the clusters in ``changes`` are looked at anew; those from ``k`` on are new.
        """
        at = np.array(sorted(changes))
        old = at < self.k
        n, n1 = np.zeros(len(at), np.int64), np.zeros((len(at), self.m), np.int64)
        n[old], n1[old] = self.n[at[old]], self.n1[at[old]]
        before = self.parts[:, at[old]]
        n += np.array([changes[c][0] for c in at])
        n1 += np.array([changes[c][1] for c in at])
        after = self._marginals(n[n > 0], n1[n > 0])
        k = self.k - int(old.sum()) + int((n > 0).sum())
        h = [self.parts[s].sum(0) - before[s].sum(0) + after[s].sum(0) for s in (0, 1)]
        strong = self._strong_sum(k) - self._strong(before, k).sum(0) + self._strong(after, k).sum(0)
        return self._total(h[0], h[1], strong)[0], k

    def effective(self) -> tuple[np.ndarray, np.ndarray]:
        """a and b of the state that each attribute is in, by cluster."""
        z = self.states() - 1
        return np.take_along_axis(self.a, z, 0), np.take_along_axis(self.b, z, 0)

    def own_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """For members of each cluster without themselves: the sum for a unit without ones, and what a one adds."""
        return _weights(*own_logs(*self.effective(), self.n[:, None], self.n1))

    def other_weights(self) -> tuple[np.ndarray, np.ndarray]:
        return _weights(*other_logs(*self.effective(), self.n[:, None], self.n1))

    def new_values(self, n: int, n1: np.ndarray) -> np.ndarray:
        """Log scores by attribute of one cluster more, of n units with n1 ones; classes stay, 3 or 4 is chosen anew."""
        return self.new_chosen(self._marginals(np.array([n]), n1[None])[:, 0])

    def new_chosen(self, parts: np.ndarray) -> np.ndarray:
        """The same from the log marginals of the new cluster by state and attribute."""
        third, fourth = self._state_logs(self.k + 1)
        if self._kind is None:
            self._kind = np.minimum(self.states()[0], 3)
        parts, kind = parts + (self.logs / (self.k + 1))[:, None], self._kind
        return np.where(kind == 3, np.maximum(parts[2] + third, parts[3] + fourth), np.where(kind == 2, parts[1], parts[0]))

    def split_constant(self) -> float:
        """What the priors of all present clusters change by when there is one cluster more."""
        z = self.states()
        now, then = self._prior(z, self.k), self._prior(z, self.k + 1)
        return float((then - now)[np.isfinite(now)].sum())

    def merge_constants(self) -> np.ndarray:
        """By cluster: what the priors change by when it is merged into another."""
        if self.k < 2:
            return np.zeros(self.k)
        now, then = self._prior(self.states(), self.k).sum(1), self._prior(self.states(), self.k - 1).sum(1)
        if not np.isfinite(then).all():  # to one cluster: states are chosen anew, the guess leaves them out
            then = now
        return then.sum() - then - now.sum()

    def _prior(self, z: np.ndarray, k: int) -> np.ndarray:
        third, fourth = self._state_logs(k)
        return np.array([self.logs[0] / k, self.logs[1] / k, self.logs[2] / k + third, self.logs[3] / k + fourth])[z - 1]


def own_logs(a: np.ndarray, b: np.ndarray, n: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weights without and with a one, for a member that is itself among the n; where no member can need one of
    them, it is set to the other."""
    rest = np.log(a + b + n - 1)
    with_one, without = np.log(np.where(n1 > 0, a + n1 - 1, 1.0)), np.log(np.where(n1 < n, b + n - 1 - n1, 1.0))
    return np.where(n1 == n, with_one, without) - rest, np.where(n1 == 0, without, with_one) - rest


def other_logs(a: np.ndarray, b: np.ndarray, n: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest = np.log(a + b + n)
    return np.log(b + n - n1) - rest, np.log(a + n1) - rest


def _weights(without: np.ndarray, with_one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return without.sum(-1), with_one - without

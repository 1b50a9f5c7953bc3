"""Plain sparse coefficients, the lasso of every row over all other rows, by homotopy.

As the weight of the penalty falls, a lasso's coefficients are piecewise linear: between two corners the active atoms stay the
same. A row's path is followed from the weight at which all is zero down to the wanted one, corner by corner, over a pool of
few atoms; atoms come by in blocks as in column generation, and those whose correlation with what the pool leaves exceeds the
weight join it. A pass in which none does proves that the pool's solution is that of all atoms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .column_generation import ERROR, Held, settle, states
from .self_expression import Solver

#: Places of a row's pool beyond one a feature, which is as many atoms as a solution needs.
SPARE = 8
#: Atoms of a block that join a pool at once.
AT_ONCE = 6
#: Atoms in a block of those that come by.
BLOCK = 2048
SLACK = 1e-10


def path_end(x: np.ndarray, atoms: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients w of the least of |x - w atoms|^2 / (2 d) + alpha |w|_1 for atoms as rows, at the end of the path."""
    d, w = len(x), np.zeros(len(atoms))
    products, left = atoms @ atoms.T / d, atoms @ x / d
    weight = np.abs(left).max(initial=0)
    if weight <= alpha:
        return w
    active, last = [int(np.abs(left).argmax())], -1
    for _ in range(50 * (len(atoms) + 1)):
        try:
            way = np.linalg.solve(products[np.ix_(active, active)], np.sign(left[active]))
        except np.linalg.LinAlgError:  # equal atoms
            way = np.linalg.lstsq(products[np.ix_(active, active)], np.sign(left[active]), rcond=None)[0]
        fall = products[:, active] @ way
        rest = np.delete(np.arange(len(atoms)), active)
        with np.errstate(divide="ignore", invalid="ignore"):
            meets = np.concatenate(((weight - left[rest]) / (1 - fall[rest]), (weight + left[rest]) / (1 + fall[rest])))
            ends = -w[active] / way
        tiny = 1e-14 * weight
        # the atom of the last corner stands exactly on its bound and is no corner again at once
        meets, ends = np.where((meets > tiny) & (np.tile(rest, 2) != last), meets, np.inf), np.where((ends > tiny) & (np.array(active) != last), ends, np.inf)
        step = min(weight - alpha, meets.min(initial=np.inf), ends.min(initial=np.inf))
        w[active] += step * way
        left -= step * fall
        weight -= step
        if weight <= alpha * (1 + 1e-15):
            break
        if ends.min(initial=np.inf) <= meets.min(initial=np.inf):
            last = active.pop(int(ends.argmin()))
            w[last] = 0
            if not active:
                break
        else:
            last = int(rest[int(meets.argmin()) % len(rest)])
            active.append(last)
    return w


def path_ends(x: np.ndarray, atoms: np.ndarray, used: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """``path_end`` of many rows: x (rows, features), atoms (rows, places, features), which of the places are used, and weights. The
    corners of all rows are passed side by side."""
    n, m, d = atoms.shape
    products, left = atoms @ np.swapaxes(atoms, 1, 2) / d, (atoms @ x[:, :, None])[:, :, 0] / d
    w, active, last = np.zeros((n, m)), np.zeros((n, m), bool), np.full(n, -1)
    weight = np.where(used, np.abs(left), 0).max(axis=1, initial=0)
    live = np.flatnonzero(weight > alpha)
    active[live, np.where(used, np.abs(left), -1)[live].argmax(axis=1)] = True
    for _ in range(50 * (m + 1)):
        if not len(live):
            break
        on, part, at = active[live], products[live], np.arange(len(live))
        system = np.where(on[:, :, None] & on[:, None, :], part, np.eye(m))
        try:
            way = np.linalg.solve(system, np.where(on, np.sign(left[live]), 0)[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # equal atoms in some row
            for r in live:
                w[r] = 0
                w[r, used[r]] = path_end(x[r], atoms[r, used[r]], float(alpha[r]))
            break
        fall = (part @ way[:, :, None])[:, :, 0]
        now, rest, stays = weight[live][:, None], used[live] & ~on, np.arange(m) == last[live][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            meets = np.minimum(*(np.where(rest & ~stays & (v > 1e-14 * now), v, np.inf) for v in ((now - left[live]) / (1 - fall), (now + left[live]) / (1 + fall))))
            ends = -w[live] / way
        ends = np.where(on & ~stays & (ends > 1e-14 * now), ends, np.inf)
        meet, end = meets.min(axis=1), ends.min(axis=1)
        step = np.minimum(np.minimum(meet, end), weight[live] - alpha[live])
        w[live] += step[:, None] * np.where(on, way, 0)
        left[live] -= step[:, None] * fall
        weight[live] -= step
        goes = end <= meet
        place = np.where(goes, ends.argmin(axis=1), meets.argmin(axis=1))
        there = weight[live] <= alpha[live] * (1 + 1e-15)
        moved = ~there
        off = live[moved & goes]
        w[off, place[moved & goes]] = 0
        active[live[moved], place[moved]] = ~goes[moved]
        last[live[moved]] = place[moved]
        live = live[moved & active[live].any(axis=1)]
    return w


class Pools(Held):
    """Each row's pool: ids of its atoms, their coefficients (``signs``) and vectors, ERROR where a place is free."""

    AT_ONCE = BLOCK
    FREE = 0.0

    @classmethod
    def begin(cls, x: np.ndarray, ids: np.ndarray, point: np.ndarray, solvers: list[Solver]):
        n, d = x.shape
        return cls(x, ids, point, np.full((n, d + SPARE), ERROR), np.zeros((n, d + SPARE)), np.zeros((n, d + SPARE, d)), solvers)

    def _take(self, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        d = self.x.shape[1]
        for _ in range(20 * d):
            left = self.x[rows] - (self.signs[rows][:, None, :] @ self.vectors[rows])[:, 0]
            size = np.abs(left @ block.T)
            size[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
            bound = self.lam[rows] * d * (1 + SLACK)
            moving = size.max(axis=1) > bound
            rows, own, size, bound = rows[moving], own[moving], size[moving], bound[moving]
            if not len(rows):
                return
            best = np.argpartition(-size, min(AT_ONCE, len(ids)) - 1, axis=1)[:, :AT_ONCE]
            # of atoms that are in the pool, rounding alone is beyond the weight
            fresh = (np.take_along_axis(size, best, axis=1) > bound[:, None]) & ~(ids[best][:, :, None] == self.atoms[rows][:, None, :]).any(axis=2)
            new = fresh.any(axis=1)
            rows, own, best, fresh = rows[new], own[new], best[new], fresh[new]
            if not len(rows):
                return
            self._solve(rows, np.where(fresh, ids[best], ERROR), np.where(fresh[:, :, None], block[best], 0))
            self.entered[rows] += 1

    def _solve(self, rows: np.ndarray, atoms: np.ndarray, vectors: np.ndarray) -> None:
        places = self.atoms.shape[1]
        atoms, vectors = np.hstack((self.atoms[rows], atoms)), np.concatenate((self.vectors[rows], vectors), axis=1)
        full = int((atoms != ERROR).sum(axis=1).max())  # places in use go first
        order = np.argsort(atoms == ERROR, axis=1, kind="stable")[:, :full]
        atoms, vectors = np.take_along_axis(atoms, order, axis=1), np.take_along_axis(vectors, order[:, :, None], axis=1)
        w = path_ends(self.x[rows], vectors, atoms != ERROR, self.lam[rows])
        if (w != 0).sum(axis=1).max() > places:
            raise ArithmeticError("more atoms than equations in a lasso")
        order = np.argsort(w == 0, axis=1, kind="stable")[:, :places]
        w, atoms, vectors = np.take_along_axis(w, order, axis=1), np.take_along_axis(atoms, order, axis=1), np.take_along_axis(vectors, order[:, :, None], axis=1)
        m, none = w.shape[1], w == 0
        self.atoms[rows], self.signs[rows], self.vectors[rows] = ERROR, 0, 0
        self.atoms[rows, :m], self.signs[rows, :m], self.vectors[rows, :m] = np.where(none, ERROR, atoms), w, np.where(none[:, :, None], 0, vectors)


def _values(batches: Iterator[pa.RecordBatch], solvers: list[Solver]) -> Iterator[pa.RecordBatch]:
    for p, _, _ in states(batches, solvers, Pools):
        r, k = np.nonzero(p.atoms != ERROR)
        yield pa.RecordBatch.from_arrays([pa.array(p.atoms[r, k]), pa.array(p.ids[r]), pa.array(p.signs[r, k])], ["i", "j", "value"])


def lasso_coefficients(rows: DataFrame, id_col: str, features: str = "features", alpha: float = 0.001) -> DataFrame:
    """(i, j, value) of plain sparse coefficients, exactly: row j of unit length over all other rows i, the least of
    |x - D w|^2 / (2 features) + alpha |w|_1. One row an id; a zero row has none. Rows that fail to settle are an error."""
    if alpha <= 0:
        raise ValueError("the weight must be above 0")
    solvers = [Solver(alpha, 1.0)]
    settled, _ = settle(rows, id_col, features, solvers, Pools)
    if not settled.where("NOT settled").isEmpty():
        raise ArithmeticError("the atoms in use did not settle")
    return settled.mapInArrow(lambda b: _values(b, solvers), "i long, j long, value double").where(F.col("value") != 0)

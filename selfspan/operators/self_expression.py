"""Self-expressive coefficients of rows over a dictionary of bounded size.

Rows X (unit length) are written as combinations of dictionary rows: min lambda * R(C) + gamma * |E|_1 with X = D C + E,
no row using itself. With the dictionary being all rows this is robust sparse (R = L1) or robust low-rank (R = nuclear
norm) subspace clustering; a table of more than ``ATOMS`` rows uses the rows of least hash as landmarks, so that what is
broadcast stays bounded, and every other row is fitted over them.

The sparse problem separates by row but for its stopping test: tasks iterate their own rows and return the norms of each
iteration, whose sums over the tasks tell where the whole problem stops; then they iterate to there. Most problems stop
within FEW iterations, which is all the norms that are asked for at first. The low-rank problem does not separate: one
task solves it over the dictionary. The nuclear norm is the least of half the squared norms of two factors; the other rows
keep the left factor that the dictionary gave and find their right one, which separates again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import truncate

#: Rows of a dictionary at most: at 64 features, 0.5 MB to broadcast, and 8 MB for a dense matrix over it.
ATOMS = 1024


@dataclass(frozen=True)
class Solver:
    """Settings of the alternating direction solver."""

    lam: float
    gamma: float
    mu: float = 1.0
    rho: float = 1.5
    max_mu: float = 1e6
    max_iter: int = 1000
    tol: float = 1e-6
    zero_diagonal: bool = True

    def __post_init__(self):
        if self.lam < 0 or self.gamma < 0 or self.mu <= 0 or self.rho <= 1 or self.max_iter < 1 or self.tol <= 0:
            raise ValueError(f"out of range: {self}")


#: The settings of the final models, and the names that methods go by.
SPARSE = Solver(lam=0.025897373396156047, gamma=0.3986470631277377)
LOW_RANK = Solver(lam=1.2247448713915892, gamma=0.38729833462074176)
ALIASES = {"ssc": "sparse", "sparse": "sparse", "robust_sparse": "sparse", "lrsc": "low_rank", "low_rank": "low_rank", "robust_low_rank": "low_rank", "sparse_all": "sparse_all", "low_rank_all": "low_rank_all"}


def method_names(value: str) -> list[str]:
    """Canonical names of a method or of both; ``both_all``: the sparse one over all rows, without landmarks."""
    if value in ("both", "all", "both_all"):
        return ["sparse_all" if value == "both_all" else "sparse", "low_rank"]
    if value not in ALIASES:
        raise ValueError(f"unknown method {value!r}")
    return [ALIASES[value]]


def soft(a: np.ndarray, tau: float) -> np.ndarray:
    return a - np.clip(a, -tau, tau)


def shrink_singular_values(a: np.ndarray, tau: float) -> np.ndarray:
    u, s, v = np.linalg.svd(a, full_matrices=False)
    return (u * np.maximum(s - tau, 0)) @ v


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def l2_normalise(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows of unit length; a zero row stays zero."""
    norm = F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("__n", norm).withColumn(features, F.transform(features, lambda x: F.coalesce(F.try_divide(x, F.col("__n")), F.lit(0.0)))).drop("__n")


@dataclass
class Fit:
    """Coefficients C (atoms x rows), their shrunk twin J, error E (features x rows), and how it went."""

    c: np.ndarray
    j: np.ndarray
    e: np.ndarray
    iterations: int
    converged: bool


def _solve(atoms: np.ndarray):
    """b -> (I + D'D)^-1 b = b - D'(I + DD')^-1 D b: a system of the features' size."""
    inner = np.linalg.inv(np.eye(len(atoms)) + atoms @ atoms.T)
    return lambda b: b - atoms.T @ (inner @ (atoms @ b))


def _step(x, atoms, solve, clear, shrink, s: Solver, mu, c, e, y1, y2) -> tuple[np.ndarray, ...]:
    """One round of updates: (c, j, e, y1, y2) and four sums of squares: of both residuals and of both changes."""
    lift = y2 / mu
    j = clear(shrink(c + lift, s.lam / mu))
    y1 = y1 / mu
    new_e = soft(x - atoms @ c + y1, s.gamma / mu)
    right = atoms.T @ (x - new_e + y1)
    right += j
    right -= lift
    new_c = clear(solve(right))
    r1, r2 = x - atoms @ new_c - new_e, new_c - j
    square = lambda a: float(np.vdot(a, a))
    sums = [square(r1), square(r2), square(new_c - c), square(new_e - e)]
    if not np.isfinite(sums).all():
        raise ArithmeticError("the iteration left the finite numbers")
    lift += r2
    lift *= mu
    return new_c, j, new_e, (y1 + r1) * mu, lift, sums


def iterate(x: np.ndarray, atoms: np.ndarray, own: np.ndarray, s: Solver, low_rank: bool) -> Fit:
    """Fit the columns of ``x`` over the columns of ``atoms`` as one problem; ``own``: which atom each column is, or -1."""
    solve, at = _solve(atoms), np.flatnonzero(own >= 0)

    def clear(a: np.ndarray) -> np.ndarray:
        if s.zero_diagonal:
            a[own[at], at] = 0
        return a

    shape = (atoms.shape[1], x.shape[1])
    c, e, y1, y2, mu = np.zeros(shape), np.zeros_like(x), np.zeros_like(x), np.zeros(shape), s.mu
    for k in range(1, s.max_iter + 1):
        c, j, e, y1, y2, sums = _step(x, atoms, solve, clear, shrink_singular_values if low_rank else soft, s, mu, c, e, y1, y2)
        if max(sums) < s.tol**2:
            return Fit(c, j, e, k, True)
        mu = min(s.rho * mu, s.max_mu)
    return Fit(c, j, e, s.max_iter, False)


def fit_columns(x: np.ndarray, atoms: np.ndarray, own: np.ndarray, s: Solver, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse fits of some columns of a problem after ``steps`` iterations: (c, j, e), and each iteration's four sums of squares:
    both residuals and both changes."""
    solve, at = _solve(atoms), np.flatnonzero(own >= 0)

    def clear(a: np.ndarray) -> np.ndarray:
        if s.zero_diagonal:
            a[own[at], at] = 0
        return a

    shape = (atoms.shape[1], x.shape[1])
    c, j, e, y1, y2, mu = np.zeros(shape), np.zeros(shape), np.zeros_like(x), np.zeros_like(x), np.zeros(shape), s.mu
    norms = np.zeros((steps, 4))
    for k in range(steps):
        c, j, e, y1, y2, norms[k] = _step(x, atoms, solve, clear, soft, s, mu, c, e, y1, y2)
        mu = min(s.rho * mu, s.max_mu)
    return c, j, e, norms


def fit_over_factor(x: np.ndarray, atoms: np.ndarray, left: np.ndarray, s: Solver) -> tuple[np.ndarray, ...]:
    """Low-rank fits of columns that are no atoms, over a given left factor: each finds its right factor a, the least of
    lambda / 2 * |a|^2 + gamma * |x - D left a|_1: (c, j, e, iterations, converged by column). A column stops once it is
    within the tolerance by itself."""
    g = atoms @ left
    values, basis = np.linalg.eigh(g.T @ g)
    n, mu = x.shape[1], s.mu
    a, e, y = np.zeros((left.shape[1], n)), np.zeros_like(x), np.zeros_like(x)
    iterations, converged = np.full(n, s.max_iter), np.zeros(n, bool)
    for k in range(1, s.max_iter + 1):
        new_e = soft(x - g @ a + y / mu, s.gamma / mu)
        new_a = basis @ ((basis.T @ (g.T @ (x - new_e + y / mu))) / (values + s.lam / mu)[:, None])
        r = x - g @ new_a - new_e
        y += mu * r
        worst = np.max([(v * v).sum(axis=0) for v in (r, new_a - a, new_e - e)], axis=0)
        a, e = new_a, new_e
        done = (worst < s.tol**2) | converged
        iterations[done & ~converged] = k
        converged = done
        if done.all():
            break
        mu = min(s.rho * mu, s.max_mu)
    c = left @ a
    return c, c, e, iterations, converged


def dictionary(rows: DataFrame, id_col: str, features: str = "features", atoms: int = ATOMS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors as columns) of all rows, or of the ``atoms`` of least hash of the id."""
    chosen = rows.select(id_col, features).orderBy(F.xxhash64(id_col), id_col).limit(atoms).collect()
    chosen.sort(key=lambda r: r[0])
    return np.array([r[0] for r in chosen]), unit_rows(np.array([r[1] for r in chosen], float).reshape(len(chosen), -1)).T


_FIT = "j long, iterations int, converged boolean, size2 double, residual2 double, rebuilt2 double, error2 double, error1 double, twin1 double, twin_active int, atoms array<long>, values array<double>, error array<double>"
#: Rows fitted at once: at ATOMS atoms, 1 MB a matrix, which stays in a core's cache.
CHUNK = 128


def _active(a: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Which entries stand out from the largest of their column, or of all."""
    return np.abs(a) > np.maximum(1e-6 * np.abs(a).max(axis=axis, initial=0, keepdims=axis is not None), 1e-10)


def _fitted(own_id: np.ndarray, x: np.ndarray, ids: np.ndarray, atoms: np.ndarray, c, j, e, iterations, converged) -> pa.RecordBatch:
    """Rows of a fit: norms, and the coefficients that stand out in their row."""
    kept = _active(c, 0)
    square = lambda a: pa.array((a * a).sum(axis=0))
    rebuilt = x - atoms @ c
    columns = [
        pa.array(own_id, pa.int64()), pa.array(iterations, pa.int32()), pa.array(converged), square(x), square(rebuilt - e), square(rebuilt), square(e), pa.array(np.abs(e).sum(axis=0)), pa.array(np.abs(j).sum(axis=0)),
        pa.array(_active(j, 0).sum(axis=0), pa.int32()), pa.array([ids[kept[:, k]] for k in range(x.shape[1])], pa.list_(pa.int64())), pa.array([c[kept[:, k], k] for k in range(x.shape[1])], pa.list_(pa.float64())), pa.array(list(e.T), pa.list_(pa.float64())),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _FIT.split(", ")])


POINT = ["lambda", "gamma"]
_GRID = f"lambda double, gamma double, {_FIT}, failure string, norms array<double>"
_ARROW = pa.schema([("lambda", pa.float64()), ("gamma", pa.float64()), ("j", pa.int64()), ("iterations", pa.int32()), ("converged", pa.bool_()), *((c, pa.float64()) for c in ("size2", "residual2", "rebuilt2", "error2", "error1", "twin1")), ("twin_active", pa.int32()), ("atoms", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("error", pa.list_(pa.float64())), ("failure", pa.string()), ("norms", pa.list_(pa.float64()))])
#: Iterations that a sparse fit is first tried with.
FEW = 64


def _at_point(made: pa.RecordBatch | dict, s: Solver, failure: str | None = None) -> pa.RecordBatch:
    """Rows of a fit, or a row by itself, with the point they belong to."""
    if isinstance(made, dict):
        return pa.RecordBatch.from_pylist([dict.fromkeys(_ARROW.names) | {"lambda": s.lam, "gamma": s.gamma, "failure": failure} | made], schema=_ARROW)
    n = made.num_rows
    return pa.RecordBatch.from_arrays([pa.array([s.lam] * n, pa.float64()), pa.array([s.gamma] * n, pa.float64()), *made.columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.float64()))], _ARROW.names)


def _failed(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _parts(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, unit vectors as columns, which atom each is) of the rows of a task, CHUNK of them at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            own_id = part.column(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, own_id), len(ids) - 1)
            yield own_id, unit_rows(np.array(part.column(1).to_pylist(), float)).T, np.where(ids[at] == own_id, at, -1)


def _fit_batches(batches: Iterator[pa.RecordBatch], ids: np.ndarray, atoms: np.ndarray, plan: list[tuple[Solver, int, bool | None]]) -> Iterator[pa.RecordBatch]:
    """Sparse fits of every row at every point of the plan (settings, iterations, whether it has converged then, null for norms
    alone); a point that fails is a row with its message."""
    for own_id, x, own in _parts(batches, ids):
        for s, steps, converged in plan:
            try:
                c, j, e, norms = fit_columns(x, atoms, own, s, steps)
                yield _at_point({"norms": norms.ravel().tolist()}, s)
                if converged is not None:
                    yield _at_point(_fitted(own_id, x, ids, atoms, c, j, e, np.full(len(own_id), steps), np.full(len(own_id), converged)), s)
            except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
                yield _at_point({}, s, _failed(e))


def _fit_others(batches: Iterator[pa.RecordBatch], ids: np.ndarray, atoms: np.ndarray, lefts: dict, solvers: list[Solver]) -> Iterator[pa.RecordBatch]:
    """Low-rank fits of rows beyond the dictionary at every point whose dictionary was fitted."""
    for own_id, x, _ in _parts(batches, ids):
        for s in solvers:
            if (s.lam, s.gamma) in lefts:
                yield _at_point(_fitted(own_id, x, ids, atoms, *fit_over_factor(x, atoms, lefts[s.lam, s.gamma], s)), s)


def _fit_dictionary(batches: Iterator[pa.RecordBatch], ids: np.ndarray, atoms: np.ndarray, solvers: list[Solver]) -> Iterator[pa.RecordBatch]:
    """Low-rank fits of the dictionary over itself, at the points whose numbers the task gets; after each a row, j null, with
    its left factor."""
    n = len(ids)
    for batch in batches:
        for s in (solvers[k] for k in batch.column(0).to_pylist()):
            try:
                f = iterate(atoms, atoms, np.arange(n), s, True)
                u, d, _ = np.linalg.svd(f.j, full_matrices=False)
                # the leading directions, of which the rows' space has no more than there are features
                left = (u * np.sqrt(d))[:, : len(atoms)]
                singular = np.linalg.svd(f.c, compute_uv=False)
                rank = int((singular > 1e-6 * singular.max(initial=0)).sum())
                yield _at_point(_fitted(ids, atoms, ids, atoms, f.c, f.j, f.e, np.full(n, f.iterations), np.full(n, f.converged)), s)
                yield _at_point({"twin_active": rank, "converged": f.converged, "values": left.ravel().tolist()}, s)
            except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
                yield _at_point({}, s, _failed(e))


@dataclass
class Coefficients:
    """``fits``: a row of the table at a point (lambda, gamma), with its norms, iterations, coefficients and errors; how many
    rows and atoms there are; (lambda, gamma, failure) of points that failed, and the rank of low-rank points."""

    fits: DataFrame
    rows: int
    atoms: int
    solver: Solver
    failures: DataFrame
    ranks: DataFrame
    #: Makes the sums that ``summary`` is made of, at all points, from the bar of active entries: for fits whose coefficients are too
    #: many to leave the tasks for it. With a bar of 0 their ``largest`` counts.
    brief: Callable[[float], DataFrame] | None = None

    @property
    def values(self) -> DataFrame:
        """(lambda, gamma, i, j, value): atom i in row j."""
        return self.fits.select(*POINT, "j", F.explode(F.arrays_zip("atoms", "values")).alias("v")).select(*POINT, F.col("v.atoms").alias("i"), "j", F.col("v.values").alias("value"))

    @property
    def errors(self) -> DataFrame:
        """(lambda, gamma, feature, j, value), features numbered from 0."""
        return self.fits.select(*POINT, F.posexplode("error").alias("feature", "value"), "j").select(*POINT, "feature", "j", "value")

    @property
    def converged(self) -> bool:
        return self.failures.isEmpty() and bool(self.fits.agg(F.min("converged")).first()[0])

    def _sums(self) -> DataFrame:
        largest = self.fits.groupBy(*POINT).agg(F.coalesce(F.max(F.array_max(F.transform("values", F.abs))), F.lit(0.0)).alias("largest"))
        bar = F.greatest(F.lit(1e-6) * F.col("largest"), F.lit(1e-10))
        marked = self.fits.join(F.broadcast(largest), POINT).withColumn("kept", F.filter(F.arrays_zip("atoms", "values"), lambda v: F.abs(v["values"]) > bar))
        total = lambda f: F.sum(F.aggregate("values", F.lit(0.0), lambda a, v: a + f(v)))
        return marked.groupBy(*POINT).agg(
            F.max("iterations").alias("iterations"), F.min("converged").alias("Converged"), *(F.sum(c).alias(c) for c in ("size2", "residual2", "rebuilt2", "error2")), F.sum("error1").alias("error_l1"), F.sum("twin1").alias("twin_l1"),
            F.sum("twin_active").alias("twin_active"), F.max("largest").alias("largest"), total(F.abs).alias("l1"), total(lambda v: v * v).alias("square"), F.sum(F.size("kept")).alias("active"),
            F.sum(F.size(F.filter("kept", lambda v: v["atoms"] == F.col("j")))).alias("loops"), F.max(F.size("error")).alias("features"),
        )

    def summary(self) -> DataFrame:
        """One row a point: how the fit went, its errors and the structure of its coefficients. Entries above
        max(1e-6 * largest, 1e-10) are active; density is over all entries, off_diagonal_density over those of other rows."""
        n, loops = float(max(self.rows * self.atoms, 1)), min(self.rows, self.atoms)
        sums = self._sums() if self.brief is None else self.brief(max(1e-6 * (self.brief(0.0).agg(F.max("largest")).first()[0] or 0.0), 1e-10))
        size = F.greatest(F.sqrt("size2"), F.lit(float(np.finfo(float).eps)))
        out = sums.select(
            *POINT, "iterations", "Converged", "features", (F.sqrt("residual2") / size).alias("relative_error"), (F.sqrt("rebuilt2") / size).alias("reconstruction_error"), "error_l1", F.sqrt("error2").alias("error_fro"), "largest", "l1",
            F.sqrt("square").alias("frobenius"), "active", (F.col("active") / n).alias("density"), (1 - F.col("active") / n).alias("sparsity"), ((F.col("active") - F.col("loops")) / max(n - loops, 1.0)).alias("off_diagonal_density"),
            ((F.col("active") - F.col("loops")) / max(self.rows, 1)).alias("mean_active"), "twin_l1", "twin_active",
        )
        return out.join(F.broadcast(self.ranks), POINT, "left")

    def info(self) -> DataFrame:
        """(Property, Value) of a fit at one point: sizes, settings, convergence, errors, structure."""
        found = self.summary().first()
        settings = {"rows": self.rows, "atoms": self.atoms, "lambda": self.solver.lam, "gamma": self.solver.gamma, "mu": self.solver.mu, "rho": self.solver.rho, "max_mu": self.solver.max_mu, "max_iterations": self.solver.max_iter, "tolerance": self.solver.tol}
        table = settings | (found.asDict() if found else {})
        return self.fits.sparkSession.createDataFrame([(k, None if v is None else str(v)) for k, v in table.items()], "Property string, Value string")


def at_points(solver: Solver, points: list[tuple[float, float]] | None) -> list[Solver]:
    """The solver at each (lambda, gamma), or as it is."""
    return [solver] if points is None else [replace(solver, lam=float(a), gamma=float(b)) for a, b in points]


def _collected(made: DataFrame, rows: int, atoms: int, solver: Solver, more: DataFrame | None = None) -> Coefficients:
    fits = made if more is None else made.union(more)
    return Coefficients(
        fits.where("j IS NOT NULL").drop("failure", "norms"), rows, atoms, solver, fits.where("failure IS NOT NULL").groupBy(*POINT).agg(F.min("failure").alias("failure")),
        made.where("j IS NULL AND twin_active IS NOT NULL").select(*POINT, F.col("twin_active").cast("long").alias("rank")),
    )


def sparse_coefficients(rows: DataFrame, id_col: str, features: str = "features", solver: Solver = SPARSE, atoms: int = ATOMS, points: list[tuple[float, float]] | None = None) -> Coefficients:
    """Robust sparse coefficients of every row over the dictionary, at the solver's lambda and gamma or at all ``points``."""
    ids, d = dictionary(rows, id_col, features, atoms)
    n, solvers = rows.count(), at_points(solver, points)
    shared = rows.sparkSession.sparkContext.broadcast((ids, d))
    data = rows.select(F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("v"))
    width = rows.sparkSession.sparkContext.defaultParallelism
    dealt = data.repartition(max(width, -(-n // (8 * CHUNK))), "id")  # a fit is much work a row: as many tasks as cores at least

    def fit(plan: list[tuple[Solver, int, bool | None]]) -> DataFrame:
        return truncate(dealt.mapInArrow(lambda b: _fit_batches(b, *shared.value, plan), _GRID))

    def stops(made: DataFrame) -> dict[tuple[float, float], int]:
        """The first iteration of each point at which the norms of all rows are within the tolerance."""
        norms = made.where("norms IS NOT NULL").select(*POINT, F.posexplode("norms").alias("at", "x")).groupBy(*POINT, "at").agg(F.sum("x").alias("x"))
        largest = norms.groupBy(*POINT, F.floor(F.col("at") / 4).alias("k")).agg(F.max("x").alias("x")).where(F.col("x") < solver.tol**2)
        return {(r[0], r[1]): r[2] + 1 for r in largest.groupBy(*POINT).agg(F.min("k")).collect()}

    of = lambda s: (s.lam, s.gamma)
    few = min(FEW, solver.max_iter)
    done = stops(fit([(s, few, None) for s in solvers]))
    slow, made = [s for s in solvers if of(s) not in done], None
    if slow:
        made = fit([(s, solver.max_iter, False) for s in slow])
        late = stops(made)
        if late:  # rows of points that converged on the way are fitted again, to where they did
            made = made.join(F.broadcast(rows.sparkSession.createDataFrame(list(late), "lambda double, gamma double")), POINT, "left_anti")
            done |= late
    ready = fit([(s, done[of(s)], True) for s in solvers if of(s) in done]) if done else None
    found = made if ready is None else ready if made is None else made.union(ready)
    return _collected(found, n, len(ids), solver)


def low_rank_coefficients(rows: DataFrame, id_col: str, features: str = "features", solver: Solver = LOW_RANK, atoms: int = ATOMS, points: list[tuple[float, float]] | None = None) -> Coefficients:
    """Robust low-rank coefficients of every row: of the dictionary by one task a point, of other rows over its left factor."""
    ids, d = dictionary(rows, id_col, features, atoms)
    n, solvers, spark = rows.count(), at_points(solver, points), rows.sparkSession
    shared = spark.sparkContext.broadcast((ids, d))
    made = truncate(spark.range(0, len(solvers), 1, len(solvers)).mapInArrow(lambda b: _fit_dictionary(b, *shared.value, solvers), _GRID))
    if n <= len(ids):
        return _collected(made, n, len(ids), solver)
    # atoms x features numbers a point
    factors = made.where("j IS NULL AND twin_active IS NOT NULL").select(*POINT, "values").collect()
    lefts = spark.sparkContext.broadcast({(r[0], r[1]): np.array(r[2]).reshape(len(ids), -1) for r in factors})
    others = rows.select(F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("v")).where(~F.col("id").isin([int(i) for i in ids]))
    return _collected(made, n, len(ids), solver, truncate(others.mapInArrow(lambda b: _fit_others(b, *shared.value, lefts.value, solvers), _GRID)))


METHODS = {"sparse": sparse_coefficients, "low_rank": low_rank_coefficients}


def effective_rank(values: DataFrame, nodes: int, limit: int = 4096) -> int:
    """Singular values of a coefficient table over a bounded dictionary above 1e-6 of the greatest, found by one task."""
    if nodes > limit:
        raise ValueError(f"{nodes} atoms; the dense kernels take {limit}")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        found = 0
        if parts:
            t = pa.Table.from_batches(parts)
            (_, i), (_, j) = (np.unique(t.column(c).to_numpy(), return_inverse=True) for c in ("i", "j"))
            a = np.zeros((i.max() + 1, j.max() + 1))
            a[i, j] = t.column("value").to_numpy()
            s = np.linalg.svd(a, compute_uv=False)
            found = int((s > 1e-6 * s.max(initial=0)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], ["rank"])

    atoms = values.select("i").distinct().withColumnRenamed("i", "j")
    return values.join(F.broadcast(atoms), "j", "left_semi").select("i", "j", "value").repartition(1).mapInArrow(rank, "rank long").first()[0]


def low_rank_closed_form(x: np.ndarray, lam: float = 0.1) -> np.ndarray:
    """Plain low-rank coefficients: singular values of (G + lam I)^-1 G, diagonal cleared, shrunk by lam."""
    g = x.T @ x
    c = np.linalg.solve(g + lam * np.eye(len(g)), g)
    np.fill_diagonal(c, 0)
    return shrink_singular_values(c, lam)

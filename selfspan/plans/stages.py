"""The stages from a feature table to scored clusters, and running a range of them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import truncate
from ..operators import affinity, anova, column_generation, decomposition, exact_low_rank, external, internal, joins, preparation, self_expression, spectral, validation, views
from .ledger import Ledger, content_digest, write_run


@dataclass(frozen=True)
class Settings:
    """Everything a run depends on, passed explicitly."""

    id_col: str = "row_id"
    label_col: str = "label"
    missing: str = "drop"
    scaling: str = "standard"
    weighting: str = "sqrt"
    variance: float = 0.90
    components: int | None = None
    #: One method, or ``both``, or ``both_all``; ``sparse_all`` and ``low_rank_all`` have no landmarks: dictionary, graph and
    #: clusters are of all rows. Tables from the coefficients on have a column ``method``.
    method: str = "sparse"
    #: Numbers of clusters: one fit, and labels for each; tables from the labels on have a column ``k``.
    clusters: int | tuple[int, ...] = 4
    assignment: str = "kmeans"
    seed: int = 42
    atoms: int = self_expression.ATOMS
    #: Whether a fit that has not converged ends the run, after its tables are made.
    strict: bool = True
    #: Rows whose silhouette is taken, a condition over ``id``: all, which is quadratic, or a stated query set.
    silhouette_rows: str = "true"
    sparse: self_expression.Solver = self_expression.SPARSE
    low_rank: self_expression.Solver = self_expression.LOW_RANK

    def __post_init__(self):
        if min(self.ks) < 2:
            raise ValueError("two clusters at least")
        self_expression.method_names(self.method)

    @property
    def ks(self) -> tuple[int, ...]:
        return (self.clusters,) if isinstance(self.clusters, int) else tuple(self.clusters)


@dataclass
class Run:
    """What the stages have made so far; ``tables`` are DataFrames by name."""

    settings: Settings
    tables: dict[str, DataFrame] = field(default_factory=dict)
    records: list[dict] = field(default_factory=list)
    extra: dict = field(default_factory=dict)
    #: By table name: the table that a stage made and its content digest.
    digests: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)


KEYS = ["method", "k"]
#: Coefficients by method; those in ALL_ROWS need no landmarks.
METHODS = self_expression.METHODS | {"sparse_all": column_generation.sparse_coefficients, "low_rank_all": exact_low_rank.low_rank_coefficients}
ALL_ROWS = {"sparse_all", "low_rank_all"}


def start(settings: Settings, features: DataFrame, truth: DataFrame | None = None) -> Run:
    """A run over a feature table and, if there is one, the truth. With a truth, both must be aligned: the same unique ids,
    finite numbers, no empty labels, and more rows than clusters."""
    if truth is None:
        return Run(settings, {"features": features})
    validation.aligned_inputs([features, truth.select(settings.id_col, F.col(settings.label_col).cast("string").alias(settings.label_col))], settings.id_col, max(settings.ks))
    return Run(settings, {"features": features, "truth": truth})


def process(run: Run) -> None:
    """features -> processed, weights: impute, scale, weight."""
    s, df = run.settings, run.tables["features"]
    if df.isEmpty():
        raise ValueError("the feature table is empty")
    clean = preparation.scale(preparation.impute(df, s.missing, s.id_col), s.scaling, s.id_col)
    groups = preparation.feature_groups(clean.columns)
    run.tables["weights"] = preparation.weight_table(df.sparkSession, groups, s.weighting)
    run.tables["processed"] = truncate(preparation.weight_features(clean, groups, s.weighting))


def reduce_dimensions(run: Run) -> None:
    """processed -> scores (id, features), and the decomposition's loadings, variance, scree and summary."""
    s, df = run.settings, run.tables["processed"]
    names = validation.numeric_columns(df, (s.id_col, s.label_col))
    v = truncate(decomposition.vectors(df, s.id_col, names))
    c = decomposition.fit_components(v, threshold=s.variance, k=s.components)
    run.extra["components"] = c
    made = decomposition.artifacts(v, c, s.id_col, names, s.variance)
    run.tables |= {n: made[n] for n in ("loadings", "variance", "scree", "summary")}
    run.tables["scores"] = truncate(decomposition.vectors(made["scores"], s.id_col, [f"PC{k + 1}" for k in range(c.k)]))


def express(run: Run) -> None:
    """scores -> coefficients, errors, fit_info of each method. Ids must be unique and numbers finite. A fit that has not
    converged ends a strict run once its tables are there; with both methods the later one is then not fitted."""
    s, rows = run.settings, run.tables["scores"]
    validation.vector_gate(rows, s.id_col)
    stack: dict[str, DataFrame] = {}
    for method in self_expression.method_names(s.method):
        found = METHODS[method](rows, s.id_col, solver=getattr(s, method.removesuffix("_all")), atoms=s.atoms)
        run.extra[method] = found
        made = {"coefficients": found.values, "errors": found.errors, "fit_info": found.info()}
        for name, table in made.items():
            named = table.drop(*self_expression.POINT).withColumn("method", F.lit(method))
            stack[name] = stack[name].unionByName(named) if name in stack else named
        run.tables |= stack
        if s.strict and not found.converged:
            failure = found.failures.first()
            raise ArithmeticError(f"{method}: " + (failure["failure"] if failure else f"not converged in {found.solver.max_iter} iterations"))


def relate(run: Run) -> None:
    """coefficients -> affinity (method, i, j, w) among the dictionary's rows."""
    c = run.tables["coefficients"]
    landmarks = ~F.col("method").isin(*ALL_ROWS)
    atoms = F.broadcast(c.where(landmarks).select("method", F.col("i").alias("j")).distinct())  # of a bounded number
    among = c.where(landmarks).join(atoms, ["method", "j"], "left_semi").unionByName(c.where(~landmarks))
    run.tables["affinity"] = truncate(affinity.affinity(among, keys=["method"]))


def group(run: Run) -> None:
    """affinity -> labels (method, k, id, cluster) of every row, and atom_labels of the graph's nodes: one decomposition a method,
    whatever the number of ks. A row without any coefficient goes to the largest cluster."""
    s, w = run.settings, run.tables["affinity"]
    everyone, parts = run.tables["scores"].select(F.col(s.id_col).cast("long").alias("node")), []
    for method in self_expression.method_names(s.method):
        graph = w.where(F.col("method") == method)
        if method in ALL_ROWS:
            parts.append(spectral.cluster_all(graph, everyone, s.ks, s.seed, s.assignment).withColumn("method", F.lit(method)))
            continue
        ids, _ = self_expression.dictionary(run.tables["scores"], s.id_col, atoms=s.atoms)
        parts.append(spectral.cluster_nodes(graph, [int(i) for i in ids], s.ks, s.seed, s.assignment).withColumn("method", F.lit(method)))
    atoms = truncate(reduce(DataFrame.unionByName, parts))
    run.tables["atom_labels"] = atoms
    landmarks = [m for m in self_expression.method_names(s.method) if m not in ALL_ROWS]
    of = lambda t, m: t.where(F.col("method") == m).drop("method")
    found = [spectral.assign(of(run.tables["coefficients"], m), of(atoms, m), ["k"]).withColumn("method", F.lit(m)) for m in landmarks]
    votes = reduce(DataFrame.unionByName, found) if found else atoms.limit(0).withColumnRenamed("node", "j")
    largest = atoms.groupBy(*KEYS, "cluster").count().groupBy(*KEYS).agg(F.max(F.struct("count", (-F.col("cluster")).alias("minus"))).alias("b")).select(*KEYS, (-F.col("b.minus")).alias("largest"))
    everyone = run.tables["scores"].select(s.id_col).crossJoin(F.broadcast(largest))  # rows x labellings, which is the result's size
    own, vote = atoms.withColumnRenamed("node", s.id_col).withColumnRenamed("cluster", "own"), votes.withColumnRenamed("j", s.id_col).withColumnRenamed("cluster", "vote")
    joined = everyone.join(own, [*KEYS, s.id_col], "left").join(vote, [*KEYS, s.id_col], "left")
    run.tables["labels"] = truncate(joined.select(*KEYS, s.id_col, F.coalesce("own", "vote", "largest").alias("cluster")))


def picture(run: Run) -> None:
    """labels -> what the pictures of every (method, k) show: gallery places, the heatmap's order, coordinates with labels."""
    s = run.settings
    run.tables["gallery"] = views.gallery(run.tables["labels"], s.id_col, "cluster", keys=KEYS)
    run.tables["heatmap"] = views.heatmap_order(run.tables["atom_labels"], "node", "cluster", keys=KEYS)
    run.tables["coordinates"] = run.tables["labels"].join(run.tables["scores"].select(s.id_col, *[F.get("features", F.lit(d)).alias(a) for d, a in enumerate("xyz")]), s.id_col)


def evaluate(run: Run) -> None:
    """labels -> internal: one row a (method, k), with the scores of the vectors and of the graph of landmarks, and the
    eigengap of the method's graph at k. Labels must name exactly the rows."""
    s = run.settings
    ids = run.tables["scores"].select(s.id_col)
    joins.label_gate(ids, run.tables["labels"], s.id_col, "cluster", KEYS)
    rows = run.tables["scores"].join(run.tables["labels"], s.id_col)
    w, atoms = run.tables["affinity"], run.tables["atom_labels"]
    spectra = []
    for method in self_expression.method_names(s.method):
        graph, nodes = w.where(F.col("method") == method).drop("method"), atoms.where(F.col("method") == method).select("node").distinct()
        affinity.affinity_gate(graph, nodes)
        spectrum = affinity.leading_spectrum(graph, nodes, max(s.ks), tol=1e-4) if method in ALL_ROWS else affinity.laplacian_spectrum(graph, [r[0] for r in nodes.collect()])
        spectra.append(spectrum.select(F.lit(method).alias("method"), F.col("place").alias("k"), F.col("gap").alias("eigengap")))
    parts = [
        internal.silhouette(rows, s.id_col, "cluster", query=s.silhouette_rows, keys=KEYS).drop("rows"), internal.davies_bouldin(rows, "cluster", keys=KEYS), internal.calinski_harabasz(rows, "cluster", keys=KEYS),
        affinity.affinity_silhouette(w, atoms, keys=KEYS).withColumnRenamed("silhouette", "affinity_silhouette"), affinity.affinity_ratio(w, atoms, keys=KEYS).withColumnRenamed("ratio", "affinity_ratio"), affinity.normalised_cut(w, atoms, keys=KEYS),
    ]
    table = views.combine_by(parts, KEYS).join(reduce(DataFrame.unionByName, spectra), KEYS, "left")
    run.tables["internal"] = truncate(table.select(*KEYS, *views.INTERNAL))


def explain(run: Run) -> None:
    """processed and labels -> analysis of variance by (method, k)."""
    s = run.settings
    rows = run.tables["processed"].join(run.tables["labels"], s.id_col)
    run.tables["anova"] = anova.anova(rows, "cluster", validation.numeric_columns(run.tables["processed"], (s.id_col, s.label_col)), keys=KEYS)


def compare(run: Run) -> None:
    """labels and truth -> contingency and external scores by (method, k). The truth must name exactly the labelled rows."""
    s = run.settings
    truth = run.tables["truth"].select(s.id_col, s.label_col)
    joins.label_gate(run.tables["labels"].select(s.id_col).distinct(), truth, s.id_col, s.label_col)
    rows = run.tables["labels"].join(truth, s.id_col)
    run.tables["contingency"] = external.contingency(rows, "cluster", s.label_col, KEYS)
    run.tables["external"] = external.scores(run.tables["contingency"], KEYS)


#: Number, name, function, tables needed, tables made.
STAGES: list[tuple[int, str, Callable[[Run], None], tuple[str, ...], tuple[str, ...]]] = [
    (2, "process", process, ("features",), ("processed",)),
    (3, "reduce", reduce_dimensions, ("processed",), ("scores",)),
    (4, "express", express, ("scores",), ("coefficients",)),
    (5, "affinity", relate, ("coefficients",), ("affinity",)),
    (6, "cluster", group, ("affinity", "coefficients", "scores"), ("labels",)),
    (7, "pictures", picture, ("labels", "affinity", "scores"), ("gallery", "heatmap", "coordinates")),
    (8, "evaluate", evaluate, ("scores", "labels", "affinity", "atom_labels"), ("internal",)),
    (9, "anova", explain, ("processed", "labels"), ("anova",)),
    (10, "compare", compare, ("labels", "truth"), ("external",)),
]


def select_stages(first: int | None = None, last: int | None = None, only: list[str | int] | None = None) -> list[int]:
    """Stage numbers of a range or a list of numbers and names, in order, each once."""
    names = {name: n for n, name, *_ in STAGES}
    numbers = [n for n, *_ in STAGES]
    if only is not None:
        unknown = [x for x in only if x not in names and x not in numbers and not (str(x).isdigit() and int(x) in numbers)]
        if unknown:
            raise ValueError(f"unknown stages {unknown}")
        return sorted({names.get(x) or int(x) for x in only})
    return [n for n in numbers if (first or 0) <= n <= (last or max(numbers))]


def fingerprint(run: Run, stage: int) -> str:
    """Hash of the settings and of the content of what the stage reads. The content of tables that stages made is known; that
    of other tables is read, as their files may have changed."""
    needs = next(s[3] for s in STAGES if s[0] == stage)
    known = {n: run.digests[n][1] for n in needs if n in run.digests and run.digests[n][0] is run.tables.get(n)}
    parts = [json.dumps(asdict(run.settings), sort_keys=True, default=str), *(f"{n}:{known.get(n) or content_digest(run.tables[n])}" for n in needs if n in run.tables)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _take_up(run: Run, ledger: Ledger, found: dict) -> None:
    spark = next(iter(run.tables.values())).sparkSession
    for name, path in found["tables"].items():
        run.tables[name] = ledger.load(spark, path)
        run.digests[name] = (run.tables[name], found["digests"][name])


def run_stages(run: Run, stages: list[int], keep_going: bool = False, dry_run: bool = False, skip_done: bool = False, ledger: Ledger | None = None) -> Run:
    """Run stages in order. A missing input is an error; a failing stage ends the run unless ``keep_going``; a stage whose
    fingerprint has run before is skipped with ``skip_done``. With a ``ledger``, a stage's tables are kept in its folder, and
    a stage that any session has done on the same settings and content is not run: its tables are read. ``records`` tells
    what happened."""
    for n, name, f, needs, _ in STAGES:
        if n not in stages:
            continue
        if dry_run:
            run.records.append({"stage": n, "name": name, "status": "planned"})
            continue
        if lacking := [x for x in needs if x not in run.tables]:
            raise LookupError(f"stage {n} ({name}) needs {lacking}")
        spark = run.tables[needs[0]].sparkSession
        mark = fingerprint(run, n) if skip_done or ledger else None
        found = ledger.find(spark, n, mark) if ledger else None
        if found or (skip_done and any(r.get("fingerprint") == mark and r["status"] == "done" for r in run.records)):
            if found:
                _take_up(run, ledger, found)
            run.records.append({"stage": n, "name": name, "status": "skipped", "fingerprint": mark})
            continue
        before = dict(run.tables)
        try:
            f(run)
        except Exception as e:
            run.records.append({"stage": n, "name": name, "status": "failed", "error": f"{type(e).__name__}: {e}"})
            if not keep_going:
                raise
        else:
            if ledger:
                tables, digests = ledger.keep(spark, n, mark, {k: t for k, t in run.tables.items() if before.get(k) is not t})
                run.tables |= tables
                run.digests |= {k: (tables[k], d) for k, d in digests.items()}
            run.records.append({"stage": n, "name": name, "status": "done", "fingerprint": mark})
    return run


def save(run: Run, folder: str) -> str:
    """The run's tables, manifest and environment in a folder of its own."""
    return write_run(next(iter(run.tables.values())).sparkSession, folder, asdict(run.settings), run.records, run.tables)


def manifest(run: Run) -> str:
    """The records and settings as JSON."""
    return json.dumps({"settings": asdict(run.settings), "records": run.records}, indent=2, default=str)

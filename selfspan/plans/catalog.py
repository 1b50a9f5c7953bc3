"""The named queries of the engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.session import truncate
from ..operators import affinity, anova, closed_form, column_generation, decomposition, exact_low_rank, external, grid, internal, joins, lasso, preparation, self_expression, spectral, validation, views, wide_components
from ..operators import stability as shaking
from . import stages

FLAGSHIP = "subspace_clusters"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the DuckDB statement of the same rows if there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, as both engines print them."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# validation, imputation, scaling

GAPPY_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price, l_discount AS discount, 1.0::DOUBLE AS one FROM lineitem"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with gaps by a rule: null quantities and not-a-number prices."""
    gap = lambda c, k, v: F.when(F.col("l_partkey") % k == 0, v).otherwise(F.col(c))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gap("l_quantity", 7, F.lit(None)).alias("quantity"), gap("l_extendedprice", 11, F.lit(float("nan"))).alias("price"), F.col("l_discount").alias("discount"), F.lit(1.0).alias("one"))


@query(f"""WITH g AS ({GAPPY_SQL})
    SELECT 'quantity' AS feature, count(*) - count(quantity) AS missing, 0::BIGINT AS infinite, count(DISTINCT quantity) <= 1 AS constant FROM g
    UNION ALL SELECT 'price', count(*) - count(price), 0, count(DISTINCT price) <= 1 FROM g
    UNION ALL SELECT 'discount', count(*) - count(discount), 0, count(DISTINCT discount) <= 1 FROM g
    UNION ALL SELECT 'one', count(*) - count(one), 0, count(DISTINCT one) <= 1 FROM g""")
def column_checks(spark, sf_dir):
    return validation.column_checks(gappy(spark, sf_dir), ["quantity", "price", "discount", "one"])


@query("SELECT (count(*) - count(DISTINCT l_orderkey))::BIGINT AS duplicates FROM lineitem")
def duplicate_ids(spark, sf_dir):
    return validation.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""SELECT 'duplicate ids' AS "check", 'p_partkey' AS subject, (count(*) - count(DISTINCT p_partkey))::VARCHAR AS value FROM part
    UNION ALL SELECT 'not numeric', x, 'string' FROM (VALUES ('p_name'), ('p_brand'), ('p_type')) t(x)""")
def validation_report(spark, sf_dir):
    return validation.validation_report(table(spark, sf_dir, "part"), "p_partkey")


def _impute(method: str, fill: str):
    where = " WHERE quantity IS NOT NULL AND price IS NOT NULL" if method == "drop" else ""
    col = lambda c: f"round(coalesce({c}, {fill.format(c=c)}), 4) AS {c}" if fill else f"round({c}, 4) AS {c}"

    @query(f"WITH g AS ({GAPPY_SQL}) SELECT l_orderkey, l_linenumber, {col('quantity')}, {col('price')} FROM g{where}", f"impute_{method}")
    def run(spark, sf_dir):
        df = gappy(spark, sf_dir).drop("discount", "one").withColumn("key", F.struct("l_orderkey", "l_linenumber")).drop("l_orderkey", "l_linenumber")
        return rounded(preparation.impute(df, method).select("key.*", "quantity", "price"), 4)


_impute("drop", "")
_impute("mean", "(SELECT avg({c}) FROM g)")
_impute("median", "(SELECT median({c}) FROM g)")
_impute("zero", "0")


def _scaled(method: str, location: str, spread: str):
    part = lambda c: f"round(({c} - {location.format(c=c)}) / ({spread.format(c=c)} + 1e-8), 6) AS {c}"

    @query(f"SELECT p_partkey, {part('p_size')}, {part('p_retailprice')} FROM part", f"scale_{method}")
    def run(spark, sf_dir):
        return rounded(preparation.scale(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), method, "p_partkey"))


_scaled("standard", "(SELECT avg({c}) FROM part)", "(SELECT stddev_samp({c}) FROM part)")
_scaled("population", "(SELECT avg({c}) FROM part)", "(SELECT stddev_pop({c}) FROM part)")
_scaled("minmax", "(SELECT min({c}) FROM part)", "(SELECT max({c}) - min({c}) FROM part)")
_scaled("robust", "(SELECT median({c}) FROM part)", "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM part)")


@query("""SELECT 'c_acctbal' AS feature, round(avg(c_acctbal), 6) AS location, round(stddev_samp(c_acctbal), 6) AS spread FROM customer
    UNION ALL SELECT 'c_nationkey', round(avg(c_nationkey), 6), round(stddev_samp(c_nationkey), 6) FROM customer""")
def scale_statistics(spark, sf_dir):
    return rounded(preparation.scale_statistics(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "standard", "c_custkey"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice / sqrt(3), 6) AS price, round(l_discount / sqrt(3), 6) AS price_discount, round(l_tax / sqrt(3), 6) AS price_tax FROM lineitem""")
def weighted_features(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("price_discount"), F.col("l_tax").alias("price_tax"))
    groups = preparation.feature_groups(df.columns, (("Price", ("price",), (), ()), ("Amount", (), (), ("l_quantity",))))
    return rounded(preparation.weight_features(df, groups))


# joins


@query("""SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS left_only,
    (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS right_only, 0::BIGINT AS null_keys,
    (SELECT count(*) FROM (SELECT doc_id FROM (SELECT doc_id, 1 AS s FROM documents UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id, s HAVING count(*) > 1)) AS repeated_keys""")
def join_gate(spark, sf_dir):
    return joins.join_gate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS left_only,
    (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS right_only""")
def missing_keys(spark, sf_dir):
    return joins.missing_keys(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key"), "key")


@query("SELECT doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id)")
def strict_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels.select("doc_id"), "doc_id", "left_semi")
    return joins.strict_join(docs, labels.select("doc_id", "quality"), "doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_ids(spark, sf_dir):
    return joins.with_row_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "row_id")


# external scores


def scores_sql(counts: str, key: str = "1") -> str:
    """ARI, NMI, Purity of a contingency statement (k, c, l, n), one row a k."""
    return f"""WITH t AS ({counts}), a AS (SELECT k, c, sum(n) AS a, max(n) AS m FROM t GROUP BY k, c), b AS (SELECT k, l, sum(n) AS b FROM t GROUP BY k, l),
        n AS (SELECT k, sum(n) AS n, sum(n * (n - 1) / 2) AS s FROM t GROUP BY k),
        ra AS (SELECT k, sum(a * (a - 1) / 2) AS ra, sum(m) AS m, -sum(a / n.n * ln(a / n.n)) AS h FROM a JOIN n USING (k) GROUP BY k),
        cb AS (SELECT k, sum(b * (b - 1) / 2) AS cb, -sum(b / n.n * ln(b / n.n)) AS h FROM b JOIN n USING (k) GROUP BY k),
        mi AS (SELECT k, sum(t.n / n.n * ln(t.n * n.n / (a * b))) AS mi FROM t JOIN a USING (k, c) JOIN b USING (k, l) JOIN n USING (k) GROUP BY k)
        SELECT k, round((s - ra * cb / (n * (n - 1) / 2)) / ((ra + cb) / 2 - ra * cb / (n * (n - 1) / 2)), 6) AS ARI, round(mi / ((ra.h + cb.h) / 2), 6) AS NMI, round(m / n, 6) AS Purity
        FROM n JOIN ra USING (k) JOIN cb USING (k) JOIN mi USING (k)"""


@query("SELECT o_orderstatus AS Cluster, o_orderpriority AS Label, count(*) AS n FROM orders GROUP BY ALL")
def contingency(spark, sf_dir):
    return external.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""SELECT quality AS Cluster, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1" FROM labels GROUP BY quality""")
def confusion_matrix(spark, sf_dir):
    return external.confusion_matrix(external.contingency(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("SELECT * EXCLUDE k FROM (" + scores_sql("SELECT 1 AS k, quality AS c, toxic AS l, count(*)::DOUBLE AS n FROM labels GROUP BY ALL") + ")")
def external_scores(spark, sf_dir):
    return rounded(external.scores(external.contingency(table(spark, sf_dir, "labels"), "quality", "toxic")))


@query("SELECT * EXCLUDE k FROM (" + scores_sql("SELECT 1 AS k, o_orderstatus AS c, o_orderpriority AS l, count(*)::DOUBLE AS n FROM orders GROUP BY ALL") + ")")
def external_scores_orders(spark, sf_dir):
    return rounded(external.scores(external.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")))


@query(scores_sql("SELECT k, o_custkey % k AS c, o_orderpriority AS l, count(*)::DOUBLE AS n FROM orders, (VALUES (3), (4), (5), (6), (7), (8), (9), (10)) v(k) GROUP BY ALL"))
def external_sweep(spark, sf_dir):
    stacked = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("label"), F.explode(F.sequence(F.lit(3), F.lit(10))).alias("k")).withColumn("cluster", F.col("o_custkey") % F.col("k"))
    return rounded(views.external_sweep(stacked))


# analysis of variance


def anova_sql(rows: str) -> str:
    """F and eta squared of a statement (feature, g, x)."""
    return f"""WITH t AS ({rows}), g AS (SELECT feature, g, count(*) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM t WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
        w AS (SELECT feature, sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g GROUP BY feature),
        s AS (SELECT feature, max(k) AS k, max(w.n) AS n, sum(g.n * (g.m - w.m) ** 2) AS b, sum((g.n - 1) * v) AS i FROM g JOIN w USING (feature) GROUP BY feature)
        SELECT feature, k AS groups, n::BIGINT AS n, round((b / (k - 1)) / (i / (n - k)), 5) AS f, round(b / (b + i), 8) AS eta_squared FROM s"""


@query(anova_sql("SELECT 'value' AS feature, event_type AS g, value AS x FROM events"))
def anova_events(spark, sf_dir):
    f = anova.f_statistics(table(spark, sf_dir, "events"), "event_type", ["value"])
    return f.withColumns({"f": F.round("f", 5), "eta_squared": F.round("eta_squared", 8)})


@query(anova_sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS g, {c} AS x FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))))
def anova_lineitem(spark, sf_dir):
    f = anova.f_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return f.withColumns({"f": F.round("f", 5), "eta_squared": F.round("eta_squared", 8)})


@query()
def anova_p_values(spark, sf_dir):
    return anova.strongest(anova.anova(table(spark, sf_dir, "lineitem"), "l_linestatus", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("""WITH p AS (SELECT p_brand AS test, avg(p_size) / 1000.0 AS p FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p)
    SELECT test, round(p, 8) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 8) AS adjusted_p, least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) <= 0.05 AS significant FROM r""")
def adjusted_p_values(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("test")).agg((F.avg("p_size") / 1000).alias("p"))
    return rounded(anova.adjust(p, "p"), 8)


@query("""WITH p AS (SELECT p_brand AS test, CASE WHEN p_brand NOT LIKE '%3' THEN avg(p_size) / 1000.0 END AS p FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
    a AS (SELECT test, p, least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
    SELECT test, round(p, 8) AS p, round(q, 8) AS adjusted_p, q <= 0.05 AS significant FROM a UNION ALL SELECT test, NULL, NULL, false FROM p WHERE p IS NULL""")
def adjusted_p_values_nulls(spark, sf_dir):
    """Tests of which some have no p value."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("test")).agg((F.avg("p_size") / 1000).alias("p"))
    return rounded(anova.adjust(p.withColumn("p", F.when(~F.col("test").like("%3"), F.col("p"))), "p"), 8)


# vectors: components and internal scores

LONG_SQL = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS f FROM embeddings"


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("long").alias("label"))


@query(f"""WITH l AS ({LONG_SQL}) SELECT a.f AS i, b.f AS j, round(sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*), 5) AS g FROM l a JOIN l b USING (vec_id) WHERE a.f <= b.f GROUP BY ALL""")
def centred_gram(spark, sf_dir):
    return rounded(decomposition.centred_gram(embedded(spark, sf_dir)), 5)


@query()
def explained_variance(spark, sf_dir):
    return decomposition.variance_table(spark, decomposition.fit_components(embedded(spark, sf_dir)))


@query()
def variance_sweep(spark, sf_dir):
    return decomposition.variance_sweep(embedded(spark, sf_dir))


@query()
def component_scores(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    return decomposition.scores(rows, decomposition.fit_components(rows, k=8))


@query("""SELECT vec_id, f::INT AS feature, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM (""" + LONG_SQL + ")")
def row_l2(spark, sf_dir):
    rows = self_expression.l2_normalise(embedded(spark, sf_dir))
    return rounded(rows.select("vec_id", F.posexplode("features").alias("feature", "value")))


@query(f"""SELECT vec_id AS i, f::BIGINT AS j, round(sign(x) * greatest(abs(x) - 0.1, 0), 6) + 0.0 AS value FROM ({LONG_SQL})""")
def soft_threshold(spark, sf_dir):
    c = embedded(spark, sf_dir).select(F.col("vec_id").alias("i"), F.posexplode("features").alias("j", "value")).withColumn("j", F.col("j").cast("long"))
    return rounded(affinity.threshold(c, 0.1)).withColumn("value", F.col("value") + F.lit(0.0))


PAIR_SQL = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, count(*) AS n FROM e GROUP BY label)"""


@query(PAIR_SQL + """, s AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS d FROM e a, e b GROUP BY ALL),
    r AS (SELECT vec_id, max(CASE WHEN own = other THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b, max(CASE WHEN own = other THEN n END) AS n FROM s JOIN c ON c.label = other GROUP BY vec_id)
    SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS rows FROM r""")
def silhouette(spark, sf_dir):
    return rounded(internal.silhouette(embedded(spark, sf_dir), "vec_id", "label"))


@query(PAIR_SQL + """, s AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS d FROM e a, e b WHERE a.vec_id % 5 = 0 GROUP BY ALL),
    r AS (SELECT vec_id, max(CASE WHEN own = other THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b, max(CASE WHEN own = other THEN n END) AS n FROM s JOIN c ON c.label = other GROUP BY vec_id)
    SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS rows FROM r""")
def silhouette_query(spark, sf_dir):
    """The silhouette of a stated query set against all rows."""
    return rounded(internal.silhouette(embedded(spark, sf_dir), "vec_id", "label", query="id % 5 = 0"))


CENTROID_SQL = f"WITH l AS ({LONG_SQL}), m AS (SELECT label, f, avg(x) AS m, count(*) AS n FROM l GROUP BY ALL)"


@query(CENTROID_SQL + """, p AS (SELECT label, vec_id, sqrt(sum((x - m) ** 2)) AS d FROM l JOIN m USING (label, f) GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM p GROUP BY label),
    q AS (SELECT a.label, b.label AS other, sqrt(sum((a.m - b.m) ** 2)) AS d FROM m a JOIN m b USING (f) WHERE a.label <> b.label GROUP BY ALL)
    SELECT round(avg(r), 6) AS dbi FROM (SELECT q.label, max((x.s + y.s) / d) AS r FROM q JOIN s x ON x.label = q.label JOIN s y ON y.label = q.other GROUP BY q.label)""")
def davies_bouldin(spark, sf_dir):
    return rounded(internal.davies_bouldin(embedded(spark, sf_dir), "label"))


@query(CENTROID_SQL + """, t AS (SELECT f, avg(x) AS t FROM l GROUP BY f), b AS (SELECT sum(n * (m - t) ** 2) AS b, count(DISTINCT label) AS k FROM m JOIN t USING (f)),
    w AS (SELECT sum((x - m) ** 2) AS w, count(DISTINCT vec_id) AS n FROM l JOIN m USING (label, f)) SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS chi FROM b, w""")
def calinski_harabasz(spark, sf_dir):
    return rounded(internal.calinski_harabasz(embedded(spark, sf_dir), "label"), 5)


# a trade graph of nations: coefficients, affinity, cuts

TRADE_SQL = """t AS (SELECT c_nationkey::BIGINT AS i, s_nationkey::BIGINT AS j, sum(l_extendedprice * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)) AS value
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    u AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, abs(value) AS w FROM t WHERE i <> j UNION ALL SELECT j, i, abs(value) FROM t WHERE i <> j) GROUP BY ALL),
    w AS (SELECT i, j, w / (SELECT max(w) FROM u) AS w FROM u WHERE w > 0), n AS (SELECT n_nationkey::BIGINT AS node, n_regionkey::BIGINT AS cluster FROM nation),
    z AS (SELECT w.i, w.j, w, a.cluster AS ci, b.cluster AS cj FROM w JOIN n a ON a.node = w.i JOIN n b ON b.node = w.j)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, value): what customers of nation i spend with suppliers of nation j, returns counted against."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.sum(F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("value"))


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("cluster"))
    return affinity.affinity(trade(spark, sf_dir)), nations


@query(f"WITH {TRADE_SQL} SELECT i, j, round(w, 6) AS w FROM w")
def symmetric_affinity(spark, sf_dir):
    return rounded(trade_graph(spark, sf_dir)[0])


@query(f"""WITH {TRADE_SQL}, p AS (SELECT count(*) FILTER (a.cluster = b.cluster) AS pi, count(*) FILTER (a.cluster <> b.cluster) AS po FROM n a JOIN n b ON a.node < b.node)
    SELECT round((sum(w) FILTER (ci = cj) / max(pi)) / (sum(w) FILTER (ci <> cj) / max(po)), 6) AS ratio FROM z, p WHERE i < j""")
def affinity_ratio(spark, sf_dir):
    return rounded(affinity.affinity_ratio(*trade_graph(spark, sf_dir)))


@query(f"WITH {TRADE_SQL} SELECT round(sum(c), 6) AS ncut FROM (SELECT ci, coalesce(sum(w) FILTER (ci <> cj), 0) / sum(w) AS c FROM z GROUP BY ci)")
def normalised_cut(spark, sf_dir):
    return rounded(affinity.normalised_cut(*trade_graph(spark, sf_dir)))


@query(f"""WITH {TRADE_SQL}, d AS (SELECT a.node AS i, a.cluster AS own, b.cluster AS other, CASE WHEN a.node = b.node THEN 0 ELSE 1 - coalesce(w, 0) END AS d FROM n a CROSS JOIN n b LEFT JOIN w ON w.i = a.node AND w.j = b.node),
    s AS (SELECT i, own, other, sum(d) AS d, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT i, max(CASE WHEN own = other THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b, max(CASE WHEN own = other THEN n END) AS n FROM s GROUP BY i)
    SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM r""")
def affinity_silhouette(spark, sf_dir):
    return rounded(affinity.affinity_silhouette(*trade_graph(spark, sf_dir)))


@query(f"""WITH {TRADE_SQL}, m AS (SELECT max(abs(value)) AS m FROM t)
    SELECT round(m, 2) AS largest, count(*) FILTER (abs(value) > greatest(1e-6 * m, 1e-10)) AS active, round(count(*) FILTER (abs(value) > greatest(1e-6 * m, 1e-10)) / 625.0, 6) AS density,
        round(count(*) FILTER (i <> j AND abs(value) > greatest(1e-6 * m, 1e-10)) / 600.0, 6) AS off_diagonal_density, round(sum(abs(value)), 2) AS l1 FROM t, m GROUP BY m""")
def coefficient_structure(spark, sf_dir):
    r = affinity.coefficient_structure(trade(spark, sf_dir), table(spark, sf_dir, "nation").count())
    return r.withColumns({"largest": F.round("largest", 2), "l1": F.round("l1", 2), "density": F.round("density", 6), "off_diagonal_density": F.round("off_diagonal_density", 6)})


@query()
def eigengap(spark, sf_dir):
    w, nations = trade_graph(spark, sf_dir)
    return affinity.laplacian_spectrum(w, sorted(r["node"] for r in nations.collect()))


# subspace clustering


def projected(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    rows = embedded(spark, sf_dir)
    c = decomposition.fit_components(rows, k=k)
    return decomposition.vectors(decomposition.scores(rows.drop("label"), c), "vec_id", [f"PC{i + 1}" for i in range(c.k)])


@query()
def sparse_coefficients(spark, sf_dir):
    return self_expression.sparse_coefficients(projected(spark, sf_dir), "vec_id").values


@query()
def sparse_coefficients_all(spark, sf_dir):
    """Every row over all other rows, exactly."""
    return column_generation.sparse_coefficients(projected(spark, sf_dir), "vec_id").values


@query()
def lasso_coefficients(spark, sf_dir):
    """Plain sparse coefficients of every row over all other rows."""
    return lasso.lasso_coefficients(projected(spark, sf_dir), "vec_id")


@query()
def low_rank_closed_form(spark, sf_dir):
    """Plain low-rank coefficients of all vectors, from factors of as many columns as the components have."""
    return closed_form.low_rank_coefficients(projected(spark, sf_dir), "vec_id")


@query()
def low_rank_coefficients(spark, sf_dir):
    return self_expression.low_rank_coefficients(projected(spark, sf_dir), "vec_id").values


def word_counts(spark: SparkSession, sf_dir: str, width: int = 4096) -> DataFrame:
    """(doc_id, features): how often the words of each document fall into each of ``width`` places of a hash."""
    words = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias("w"))
    counts = words.groupBy("doc_id", F.pmod(F.xxhash64("w"), F.lit(width)).alias("at")).agg(F.count("*").alias("value"))
    return wide_components.spread(counts, "doc_id", width)


@query()
def wide_variance(spark, sf_dir):
    """Leading components of word counts of 4,096 places, without a matrix of places by places."""
    return decomposition.variance_table(spark, decomposition.fit_components(truncate(word_counts(spark, sf_dir)), k=8))


@query()
def low_rank_factors(spark, sf_dir):
    """Robust low-rank coefficients of every row over all other rows, as factors."""
    rows = truncate(projected(spark, sf_dir))
    return exact_low_rank.factors(rows, "vec_id")


@query()
def low_rank_coefficients_all(spark, sf_dir):
    """Robust low-rank coefficients of every row over all other rows, exactly."""
    return exact_low_rank.low_rank_coefficients(projected(spark, sf_dir), "vec_id").values


@query()
def coefficient_info(spark, sf_dir):
    """What each method's fit of all rows came to: settings, iterations, convergence, errors, structure."""
    rows = projected(spark, sf_dir)
    parts = [f(rows, "vec_id").info().withColumn("method", F.lit(m)) for m, f in stages.METHODS.items()]
    return reduce(DataFrame.unionByName, parts)


def clustered(spark: SparkSession, sf_dir: str, method: str, clusters: int | tuple[int, ...] = 10, assignment: str = "kmeans") -> stages.Run:
    """Stages 2 to 6 over all vectors. At ratios of lambda to gamma as in the final models; a fit that ends unconverged says so
    in ``fit_info``."""
    rows = embedded(spark, sf_dir)
    features = rows.select("vec_id", *[F.col("features")[k].alias(f"f{k}") for k in range(64)])
    s = stages.Settings(id_col="vec_id", components=8, clusters=clusters, method=method, assignment=assignment, strict=False)
    run = stages.Run(s, {"features": truncate(features), "truth": rows.select("vec_id", "label")})
    return stages.run_stages(run, stages.select_stages(2, 6))


@query()
def subspace_clusters(spark, sf_dir):
    """Every vector over all others, a graph of all vectors, its embedding and ten clusters: no landmarks."""
    return clustered(spark, sf_dir, "sparse_all").tables["labels"]


@query()
def subspace_clusters_discretized(spark, sf_dir):
    return clustered(spark, sf_dir, "low_rank", assignment="discretize").tables["labels"]


@query()
def subspace_scores(spark, sf_dir):
    """Both methods at ten clusters: internal and external scores, and whether the fit converged."""
    run = stages.run_stages(clustered(spark, sf_dir, "both_all"), stages.select_stages(8, 10))
    fits = run.tables["fit_info"].where("Property IN ('Converged', 'iterations')").groupBy("method").pivot("Property", ["Converged", "iterations"]).agg(F.first("Value"))
    return run.tables["internal"].join(run.tables["external"], stages.KEYS).join(fits, "method")


@query()
def subspace_sweep(spark, sf_dir):
    """One fit a method, labels for 3 to 10 clusters, seven metrics each."""
    run = stages.run_stages(clustered(spark, sf_dir, "both_all", tuple(range(3, 11))), [8])
    return run.tables["internal"]


@query()
def subspace_anova(spark, sf_dir):
    run = stages.run_stages(clustered(spark, sf_dir, "sparse_all", (4, 10)), [9])
    return run.tables["anova"]


SWEEP_SQL = f"""WITH s AS (SELECT vec_id, k, (vec_id % k)::BIGINT AS cluster, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS f FROM embeddings, (VALUES (3), (5), (8)) v(k)),
    m AS (SELECT k, cluster, f, avg(x) AS m, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT k, f, avg(x) AS t FROM s GROUP BY ALL),
    w AS (SELECT k, sum((x - m) ** 2) AS w, count(DISTINCT vec_id) AS n FROM s JOIN m USING (k, cluster, f) GROUP BY k),
    b AS (SELECT k, sum(n * (m - t) ** 2) AS b, count(DISTINCT cluster) AS c FROM m JOIN t USING (k, f) GROUP BY k),
    p AS (SELECT k, cluster, vec_id, sqrt(sum((x - m) ** 2)) AS d FROM s JOIN m USING (k, cluster, f) GROUP BY ALL), a AS (SELECT k, cluster, avg(d) AS s FROM p GROUP BY ALL),
    q AS (SELECT x.k, x.cluster, y.cluster AS other, sqrt(sum((x.m - y.m) ** 2)) AS d FROM m x JOIN m y ON x.k = y.k AND x.f = y.f AND x.cluster <> y.cluster GROUP BY ALL),
    r AS (SELECT q.k, q.cluster, max((u.s + v.s) / d) AS r FROM q JOIN a u ON u.k = q.k AND u.cluster = q.cluster JOIN a v ON v.k = q.k AND v.cluster = q.other GROUP BY ALL),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT k, i.vec_id % k AS own, j.vec_id % k AS other, i.vec_id, sum(CASE WHEN i.vec_id = j.vec_id THEN 0 ELSE list_distance(i.v, j.v) END) AS d, count(*) AS n
        FROM e i, e j, (VALUES (3), (5), (8)) v(k) GROUP BY ALL),
    y AS (SELECT k, vec_id, max(CASE WHEN own = other THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM z GROUP BY ALL)
    SELECT w.k, round((SELECT avg((y.b - y.a) / greatest(y.a, y.b)) FROM y WHERE y.k = w.k), 6) AS silhouette, round((SELECT avg(r) FROM r WHERE r.k = w.k), 6) AS dbi, round((b.b / (c - 1)) / (w / (n - c)), 5) AS chi FROM w JOIN b USING (k)"""


@query(SWEEP_SQL)
def internal_sweep_by_k(spark, sf_dir):
    """Three labellings of all vectors stacked in one table, scored together."""
    rows = embedded(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(3), F.lit(5), F.lit(8)))).withColumn("cluster", (F.col("vec_id") % F.col("k")).cast("long"))
    parts = [internal.silhouette(rows, "vec_id", "cluster", keys=["k"]).drop("rows"), internal.davies_bouldin(rows, "cluster", keys=["k"]), internal.calinski_harabasz(rows, "cluster", keys=["k"])]
    return rounded(views.combine_by_k(parts)).withColumn("chi", F.round("chi", 5))


@query(SWEEP_SQL.split("SELECT w.k, round")[0] + """, x AS (SELECT k, round((SELECT avg(r) FROM r WHERE r.k = w.k), 6) AS dbi, round((b.b / (c - 1)) / (w / (n - c)), 5) AS chi FROM w JOIN b USING (k))
    SELECT 'dbi' AS metric, k, dbi AS value FROM x UNION ALL SELECT 'chi', k, chi FROM x""")
def metric_lines(spark, sf_dir):
    rows = embedded(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(3), F.lit(5), F.lit(8)))).withColumn("cluster", (F.col("vec_id") % F.col("k")).cast("long"))
    table = views.combine_by_k([internal.davies_bouldin(rows, "cluster", keys=["k"]), internal.calinski_harabasz(rows, "cluster", keys=["k"])])
    return views.metric_lines(rounded(table).withColumn("chi", F.round("chi", 5)), ["dbi", "chi"])


@query()
def stability(spark, sf_dir):
    """Mean agreement of k-means clusters of all vectors with those of twenty noisy copies of them."""
    return shaking.stability(embedded(spark, sf_dir).select("vec_id", "features"), [10])


#: Steps of the registered low-rank search on each axis of its fine range, and iterations of a point: 15 steps take
#: twenty-five times as long.
LOW_RANK_STEPS, SEARCH_ITERATIONS = 3, 200


def searched(spark: SparkSession, sf_dir: str, method: str, spec: tuple, steps: int) -> grid.Search:
    """A search over all vectors, scored against their labels."""
    solver = replace(self_expression.LOW_RANK, max_iter=SEARCH_ITERATIONS) if method == "low_rank" else self_expression.SPARSE
    return grid.search(projected(spark, sf_dir), embedded(spark, sf_dir), "vec_id", "label", grid.points_of((*spec[:4], steps)), method, 10, solver=solver)


def sparse_searched(spark: SparkSession, sf_dir: str, spec: tuple) -> DataFrame:
    """Results of the sparse method over all vectors, scored against their labels."""
    return grid.sparse_results(truncate(projected(spark, sf_dir)), embedded(spark, sf_dir), "vec_id", "label", grid.points_of(spec), 10)


@query()
def grid_search(spark, sf_dir):
    """The sparse method at all points of its fine ranges, exactly, over all rows: scores and diagnostics of every point."""
    return sparse_searched(spark, sf_dir, grid.FINE_SPARSE)


@query()
def grid_search_coarse(spark, sf_dir):
    """The sparse method at all points of the coarse ranges, exactly, over all rows: the best rows."""
    return grid.regenerate(sparse_searched(spark, sf_dir, grid.COARSE))["best"]


@query()
def grid_search_low_rank(spark, sf_dir):
    """The low-rank method at points of its fine ranges: the best rows, as regenerated from the results."""
    return grid.regenerate(searched(spark, sf_dir, "low_rank", grid.FINE_LOW_RANK, LOW_RANK_STEPS).results)["best"]


@query()
def grid_search_low_rank_all(spark, sf_dir):
    """The low-rank method at all points of its fine ranges over all rows: scores and diagnostics of every point."""
    return grid.low_rank_results(truncate(projected(spark, sf_dir)), embedded(spark, sf_dir), "vec_id", "label", grid.points_of(grid.FINE_LOW_RANK), 10)


GRID_SQL = """g AS (SELECT l_discount AS "lambda", l_tax AS gamma, avg(l_quantity) AS ARI, max(l_extendedprice) AS NMI, sum(l_linenumber) % 3 > 0 AS Converged FROM lineitem GROUP BY ALL)"""


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of results by discount and tax."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_discount").alias("lambda"), F.col("l_tax").alias("gamma")).agg(F.avg("l_quantity").alias("ARI"), F.max("l_extendedprice").alias("NMI"), (F.sum("l_linenumber") % 3 > 0).alias("Converged"))


@query(f"""WITH {GRID_SQL}, t AS (SELECT 'ARI' AS Criterion, ARI AS v, * FROM g UNION ALL SELECT 'NMI', NMI, * FROM g)
    SELECT Criterion, "lambda", gamma, round(ARI, 6) AS ARI, round(NMI, 6) AS NMI, Converged FROM t QUALIFY row_number() OVER (PARTITION BY Criterion ORDER BY Converged DESC, v DESC, "lambda", gamma) = 1""")
def best_parameters(spark, sf_dir):
    return rounded(grid.best_rows(order_grid(spark, sf_dir), ["ARI", "NMI"])).select("Criterion", "lambda", "gamma", "ARI", "NMI", "Converged")


@query(f"""WITH {GRID_SQL} SELECT gamma, {", ".join(f'''round(max(ARI) FILTER ("lambda" = {k / 100}), 6) AS "d{k}"''' for k in range(11))} FROM g GROUP BY gamma""")
def pivot_grid(spark, sf_dir):
    p = grid.pivot_grid(order_grid(spark, sf_dir), "ARI")
    return rounded(p.toDF("gamma", *[f"d{round(float(c) * 100)}" for c in p.columns[1:]]))


@query(f"""WITH {GRID_SQL}, p AS (SELECT * FROM g WHERE "lambda" > 0 AND gamma > 0), b AS (SELECT "lambda" AS bl, gamma AS bg FROM p ORDER BY Converged DESC, ARI DESC, "lambda", gamma LIMIT 1)
    SELECT round(log10("lambda"), 6) AS log_lambda, round(log10(gamma), 6) AS log_gamma, round(ARI, 6) AS value, Converged, "lambda" = bl AND gamma = bg AS best FROM p, b""")
def surface(spark, sf_dir):
    return rounded(grid.surface(order_grid(spark, sf_dir).where("lambda > 0 AND gamma > 0"), "ARI"))


# geometry

SHAPE_SQL = "p AS (SELECT l_orderkey AS id, l_linenumber AS k, l_extendedprice / 1000 AS x, l_quantity AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity) AS at, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pts): an order's lines as a polygon."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y")))).alias("l"))
    return lines.select("id", F.transform("l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))


@query(f"""WITH {SHAPE_SQL}, q AS (SELECT a.id, a.x, a.y, b.x AS nx, b.y AS ny FROM p a JOIN p b ON a.id = b.id AND b.at = a.at % a.n + 1)
    SELECT id, round(abs(sum(x * ny - nx * y)) / 2, 5) AS area, round(sum(sqrt((x - nx) ** 2 + (y - ny) ** 2)), 5) AS perimeter FROM q GROUP BY id""")
def polygons(spark, sf_dir):
    p = F.col("pts")
    return rounded(shapes(spark, sf_dir).select("id", geometry.polygon_area(p).alias("area"), geometry.perimeter(p).alias("perimeter")), 5)


@query(f"""WITH {SHAPE_SQL}, q AS (SELECT a.id, a.x, a.y, b.x AS nx, b.y AS ny FROM p a JOIN p b ON a.id = b.id AND b.at = a.at % a.n + 1),
    s AS (SELECT id, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt((x - nx) ** 2 + (y - ny) ** 2)) AS around, max(x) - min(x) AS w, max(y) - min(y) AS h FROM q GROUP BY id)
    SELECT id, round(4 * pi() * area / (around * around + 1e-8), 6) AS circularity, round(h / (w + 1e-8), 5) AS aspect_ratio FROM s""")
def shape_ratios(spark, sf_dir):
    p = F.col("pts")
    size = lambda axis: F.array_max(F.transform(p, lambda q: q[axis])) - F.array_min(F.transform(p, lambda q: q[axis]))
    return shapes(spark, sf_dir).select("id", F.round(geometry.circularity(geometry.polygon_area(p), geometry.perimeter(p)), 6).alias("circularity"), F.round(geometry.aspect_ratio(size("y"), size("x")), 5).alias("aspect_ratio"))


@query(f"""WITH {SHAPE_SQL}, q AS (SELECT a.id, a.x, a.y, b.x AS nx, b.y AS ny FROM p a JOIN p b ON a.id = b.id AND b.at = a.at % a.n + 1), o AS (SELECT id, abs(sum(x * ny - nx * y)) / 2 AS area FROM q GROUP BY id),
    d AS (SELECT DISTINCT id, x, y FROM p), t AS (SELECT a.id, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn,
        (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) AS along, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 AS far FROM d a JOIN d b ON a.id = b.id AND (a.x, a.y) <> (b.x, b.y) JOIN d c ON c.id = a.id),
    e AS (SELECT id, ux, uy, vx, vy FROM t GROUP BY ALL HAVING bool_and(turn > 1e-12 OR (abs(turn) <= 1e-12 AND along >= 0 AND along <= far * (1 + 1e-12)))),
    h AS (SELECT id, nullif(round(sum(ux * vy - vx * uy) / 2, 9), 0) AS hull FROM e GROUP BY id)
    SELECT id, round(hull, 7) AS hull, round(area / (hull + 1e-8), 7) AS solidity FROM o LEFT JOIN h USING (id)""")
def hulls(spark, sf_dir):
    """Convex hulls of orders' lines, and how much of them the polygons fill."""
    p = F.col("pts")
    return shapes(spark, sf_dir).select("id", F.round(geometry.hull_area(p), 7).alias("hull"), F.round(geometry.solidity(p), 7).alias("solidity"))


@query()
def face_features(spark, sf_dir):
    """The 40 features of landmark sets made from each vector's coordinates."""
    e = F.col("features")
    x = lambda k: F.element_at(e, ((k * 7) % 64 + 1).cast("int")) + F.cos(k * 0.7)
    y = lambda k: F.element_at(e, ((k * 11 + 3) % 64 + 1).cast("int")) + F.sin(k * 0.7)
    faces = embedded(spark, sf_dir).select(F.col("vec_id").alias("Image"), F.transform(F.sequence(F.lit(0), F.lit(105)), lambda k: F.struct(x(k).alias("x"), y(k).alias("y"))).alias("pts"))
    return geometry.face_features(faces)


# views


@query("""SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS place, vec_id AS id, label::BIGINT AS cluster,
    label <> (SELECT min(label) FROM embeddings) AND row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1 AS boundary FROM embeddings""")
def heatmap_order(spark, sf_dir):
    return views.heatmap_order(embedded(spark, sf_dir), "vec_id", "label")


@query("""SELECT label::BIGINT AS cluster, vec_id AS id, (row_number() OVER w - 1) // 5 AS row, (row_number() OVER w - 1) % 5 AS "column" FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")
def gallery(spark, sf_dir):
    return views.gallery(embedded(spark, sf_dir), "vec_id", "label")

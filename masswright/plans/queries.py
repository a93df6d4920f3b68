"""The engine's queries on the star-schema tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masswright.functions import arrays, cells
from masswright.operators import measures, ot1d, power, solver
from masswright.session import shared_path
from masswright.sources import vtk

from .tables import event_values, line_diracs, line_points, part_balls, part_points, part_sites, rounded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def r(sql: str) -> str:
    return f"(round(({sql}) + 0.000000033, 6) + 0.0)"


LINE = "SELECT CAST(l_suppkey AS BIGINT) AS batch_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber, l_extendedprice, l_partkey) AS dirac_id, l_quantity / 50.0::DOUBLE AS x, CAST({mass} AS DOUBLE) AS mass FROM lineitem"
POINTS = "SELECT row_number() OVER () AS rid, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS point_id, l_quantity / 50.0::DOUBLE AS px, l_discount * 10.0::DOUBLE AS py FROM lineitem"
SITES = "SELECT CAST(p_size AS BIGINT) AS site_id, p_size / 50.0::DOUBLE AS sx, CAST(sum(CAST(round(p_retailprice * 10) AS BIGINT)) % 1000 AS BIGINT) / 1000.0::DOUBLE AS sy, 0.01::DOUBLE * (p_size % 3) AS w FROM part GROUP BY p_size"
ASSIGNED = f"""points AS ({POINTS}), sites AS ({SITES}),
best AS (SELECT point_id, px, py, site_id, cost FROM (
  SELECT p.*, s.site_id, (px - sx) * (px - sx) + (py - sy) * (py - sy) - w AS cost,
         row_number() OVER (PARTITION BY rid ORDER BY (px - sx) * (px - sx) + (py - sy) * (py - sy) - w, s.site_id) AS k
  FROM points p, sites s) WHERE k = 1)"""


def plan_ctes(diracs: str, pieces: str) -> str:
    """Stages of the general one-dimensional plan; ends with plan(batch_id, dirac_id, x, mass, m, w, barycenter, cut_lo, cut_hi, cost, potential)."""
    return f"""d AS ({diracs}), k AS ({pieces}),
kz AS (SELECT *, (y0 + y1) / 2 * (x1 - x0) AS pm, sum((y0 + y1) / 2 * (x1 - x0)) OVER (PARTITION BY batch_id) AS z FROM k),
kc AS (SELECT batch_id, piece, x0, x1, y0 / z AS y0, (y1 - y0) / (x1 - x0) / z AS s, pm / z AS c, sum(pm) OVER (PARTITION BY batch_id ORDER BY x0, piece) / z AS c1 FROM kz WHERE pm > 0),
dd AS (SELECT *, sum(mass) OVER (PARTITION BY batch_id) AS w, mass / sum(mass) OVER (PARTITION BY batch_id) AS m,
  sum(mass) OVER (PARTITION BY batch_id ORDER BY x, dirac_id) / sum(mass) OVER (PARTITION BY batch_id) AS q1 FROM d),
ov AS (SELECT d.batch_id, dirac_id, x, mass, m, w, x0, y0, s, greatest(q1 - m, c1 - c) - (c1 - c) AS tl, least(q1, c1) - (c1 - c) AS tr
  FROM dd d JOIN kc ON d.batch_id = kc.batch_id AND least(q1, c1) > greatest(q1 - m, c1 - c) + 1e-12),
lr AS (SELECT *, x0 + CASE WHEN tl > 0 THEN 2 * tl / (y0 + sqrt(greatest(0, y0 * y0 + 2 * s * tl))) ELSE 0 END AS l,
  x0 + CASE WHEN tr > 0 THEN 2 * tr / (y0 + sqrt(greatest(0, y0 * y0 + 2 * s * tr))) ELSE 0 END AS r FROM ov),
cell AS (SELECT batch_id, dirac_id, x, mass, m, w, min(l) AS cut_lo, max(r) AS cut_hi,
  sum((tr - tl) * x0 + y0 * ((r - x0) ** 2 - (l - x0) ** 2) / 2 + s * ((r - x0) ** 3 - (l - x0) ** 3) / 3) / m AS barycenter,
  sum((y0 + s * (x - x0)) * ((r - x) ** 3 - (l - x) ** 3) / 3 + s * ((r - x) ** 4 - (l - x) ** 4) / 4) AS cost
  FROM lr GROUP BY batch_id, dirac_id, x, mass, m, w),
jump AS (SELECT *, coalesce((x - cut_lo) ** 2 - (lag(x) OVER (PARTITION BY batch_id ORDER BY x, dirac_id) - cut_lo) ** 2, 0) AS j FROM cell),
plan AS (SELECT *, sum(j) OVER (PARTITION BY batch_id ORDER BY x, dirac_id) AS potential FROM jump)"""


UNIFORM = "SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS batch_id, 0 AS piece, 0.0::DOUBLE AS x0, 1.0::DOUBLE AS x1, 1.0::DOUBLE AS y0, 1.0::DOUBLE AS y1 FROM lineitem"
#: Fixed knots of the step and affine test densities.
STEP_KNOTS, STEP_VALUES = (0.0, 0.2, 0.5, 0.6, 1.0), (1.0, 3.0, 0.0, 2.0, 2.0)
AFFINE_KNOTS, AFFINE_VALUES = (0.0, 0.4, 1.0), (1.0, 0.25, 2.0)


def knots_sql(xs, ys) -> str:
    rows = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(zip(xs, ys, strict=True)))
    return f"SELECT b.batch_id, v.i, v.x, v.y FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS batch_id FROM lineitem) b, (VALUES {rows}) v(i, x, y)"


def pieces_sql(xs, ys, affine: bool) -> str:
    return f"SELECT * FROM (SELECT batch_id, i AS piece, x AS x0, lead(x) OVER w AS x1, y AS y0, {'lead(y) OVER w' if affine else 'y'} AS y1 FROM ({knots_sql(xs, ys)}) WINDOW w AS (PARTITION BY batch_id ORDER BY i)) WHERE x1 IS NOT NULL"


def knots(spark: SparkSession, sf_dir: str, xs, ys) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(zip(xs, ys, strict=True))])
    return line_diracs(spark, sf_dir).select("batch_id").distinct().select("batch_id", F.explode(rows).alias("k")).select("batch_id", "k.i", "k.x", "k.y")


def uniform_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_diracs(spark, sf_dir)
    return ot1d.plan_1d(d, measures.uniform_pieces(d.select("batch_id").distinct()))


def step_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ot1d.plan_1d(line_diracs(spark, sf_dir, "l_extendedprice"), measures.constant_pieces(knots(spark, sf_dir, STEP_KNOTS, STEP_VALUES)))


def affine_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ot1d.plan_1d(line_diracs(spark, sf_dir), measures.affine_pieces(knots(spark, sf_dir, AFFINE_KNOTS, AFFINE_VALUES)))


# Every plan output on every density: distance, barycenter, potential, cuts.
for _kind, _plan, _ctes in (
    ("uniform", uniform_plan, plan_ctes(LINE.format(mass="1.0"), UNIFORM)),
    ("step", step_plan, plan_ctes(LINE.format(mass="l_extendedprice"), pieces_sql(STEP_KNOTS, STEP_VALUES, False))),
    ("affine", affine_plan, plan_ctes(LINE.format(mass="1.0"), pieces_sql(AFFINE_KNOTS, AFFINE_VALUES, True))),
):
    query(f"WITH {_ctes} SELECT batch_id, {r('sum(cost)')} AS distance FROM plan GROUP BY batch_id", f"ot1d_{_kind}_distance")(
        lambda spark, sf_dir, plan=_plan: ot1d.distances(plan(spark, sf_dir)).select("batch_id", rounded("distance").alias("distance"))
    )
    for _column in ("barycenter", "potential"):
        query(f"WITH {_ctes} SELECT batch_id, dirac_id, {r(_column)} AS {_column} FROM plan", f"ot1d_{_kind}_{_column}")(
            lambda spark, sf_dir, plan=_plan, column=_column: plan(spark, sf_dir).select("batch_id", "dirac_id", rounded(column).alias(column))
        )
    query(f"WITH {_ctes} SELECT batch_id, dirac_id, {r('cut_lo')} AS cut_lo, {r('cut_hi')} AS cut_hi FROM plan", f"ot1d_{_kind}_cuts")(
        lambda spark, sf_dir, plan=_plan: plan(spark, sf_dir).select("batch_id", "dirac_id", rounded("cut_lo").alias("cut_lo"), rounded("cut_hi").alias("cut_hi"))
    )

_AFFINE = plan_ctes(LINE.format(mass="1.0"), pieces_sql(AFFINE_KNOTS, AFFINE_VALUES, True))


@query(f"WITH {_AFFINE} SELECT batch_id, dirac_id, {r('2 * m * (x - barycenter) * 1000')} AS d_position FROM plan")
def ot1d_grad_positions(spark, sf_dir):
    return ot1d.dirac_gradients(affine_plan(spark, sf_dir)).select("batch_id", "dirac_id", rounded(F.col("d_position") * 1000).alias("d_position"))


@query(f"WITH {_AFFINE} SELECT batch_id, dirac_id, {r('(potential - sum(m * potential) OVER (PARTITION BY batch_id)) / w * 1000')} AS d_mass FROM plan")
def ot1d_grad_weights(spark, sf_dir):
    return ot1d.dirac_gradients(affine_plan(spark, sf_dir)).select("batch_id", "dirac_id", rounded(F.col("d_mass") * 1000).alias("d_mass"))


@query(None)
def ot1d_grad_knots(spark, sf_dir):
    return ot1d.knot_gradients(line_diracs(spark, sf_dir), knots(spark, sf_dir, AFFINE_KNOTS, AFFINE_VALUES)).select("batch_id", "i", rounded("d_y").alias("d_y"), rounded("d_x").alias("d_x"))


_EVENTS = """SELECT event_id, value, (row_number() OVER (ORDER BY value, event_id) - 1) / count(*) OVER ()::DOUBLE AS q0, row_number() OVER (ORDER BY value, event_id) / count(*) OVER ()::DOUBLE AS q1 FROM events WHERE event_type = '{kind}'"""


@query(f"""WITH a AS ({_EVENTS.format(kind='click')}), b AS ({_EVENTS.format(kind='view')})
SELECT {r('sum((least(a.q1, b.q1) - greatest(a.q0, b.q0)) * (a.value - b.value) ** 2)')} AS distance FROM a JOIN b ON a.q1 > b.q0 AND b.q1 > a.q0""")
def ot1d_discrete_discrete(spark, sf_dir):
    flow = ot1d.discrete_coupling(event_values(spark, sf_dir, "click"), event_values(spark, sf_dir, "view"))
    return flow.agg(rounded(F.sum("cost")).alias("distance"))


@query(f"""WITH {plan_ctes("SELECT t.i AS batch_id, site_id AS dirac_id, sx * cos(t.i * pi() / 8) + sy * sin(t.i * pi() / 8) AS x, 1.0::DOUBLE AS mass FROM (" + SITES + ") s, range(8) t(i)",
 "SELECT i AS batch_id, 0 AS piece, -1.0::DOUBLE AS x0, 1.5::DOUBLE AS x1, 1.0::DOUBLE AS y0, 1.0::DOUBLE AS y1 FROM range(8) t(i)")}
SELECT batch_id, {r('sum(cost)')} AS distance FROM plan GROUP BY batch_id""")
def sliced_w2(spark, sf_dir):
    angles = spark.range(8).select(F.col("id").alias("batch_id"), (F.col("id") * F.pi() / 8).alias("theta"))
    points = part_sites(spark, sf_dir).select(F.col("site_id").alias("point_id"), F.get("pos", F.lit(0)).alias("px"), F.get("pos", F.lit(1)).alias("py"))
    plan = ot1d.plan_1d(ot1d.project(points, angles), measures.uniform_pieces(angles, -1.0, 1.5))
    return ot1d.distances(plan).select("batch_id", rounded("distance").alias("distance"))


@query(f"""SELECT t.i AS batch_id, s.j AS i, {r('2 * 1.5 * sqrt(greatest(0, 0.3 ** 2 - (-1 + 2 * s.j / 20.0::DOUBLE - (0.25 * cos(t.i * pi() / 8) + 0.1 * sin(t.i * pi() / 8))) ** 2))')} AS y FROM range(8) t(i), range(21) s(j)""")
def disk_sinogram(spark, sf_dir):
    samples = spark.range(8 * 21).select(F.expr("id div 21").alias("batch_id"), (F.col("id") % 21).alias("i"))
    samples = samples.withColumn("theta", F.col("batch_id") * F.pi() / 8).withColumn("x", -1 + 2 * F.col("i") / 20.0).withColumn("y", F.lit(0.0))
    return ot1d.disk_sinogram(samples, (0.25, 0.1), 0.3, 1.5).select("batch_id", "i", rounded("y").alias("y"))


@query(f"""WITH a AS (SELECT l_suppkey AS b, l_linenumber AS i, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_suppkey AS b, l_linenumber AS i, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT CAST(a.b AS BIGINT) AS batch_id, {r('sum((a.v - b.v) ** 2)')} AS l2, count(*) AS n FROM a JOIN b ON a.b = b.b AND a.i = b.i GROUP BY a.b""")
def l2_distance(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("batch_id"), F.col("l_linenumber").alias("i"), "l_returnflag").agg(F.avg("l_quantity").alias("value"))
    pick = lambda f: means.where(F.col("l_returnflag") == f).select("batch_id", "i", "value")
    return ot1d.l2_distance(pick("R"), pick("A")).select("batch_id", rounded("l2").alias("l2"), "n")


@query(f"WITH d AS ({LINE.format(mass='l_extendedprice')}) SELECT batch_id, dirac_id, {r('1000 * mass / sum(mass) OVER (PARTITION BY batch_id)')} AS mass FROM d")
def dirac_normalize(spark, sf_dir):
    return measures.normalize_diracs(line_diracs(spark, sf_dir, "l_extendedprice"), 1000.0).select("batch_id", "dirac_id", rounded("mass").alias("mass"))


@query(f"WITH d AS ({LINE.format(mass='1')}) SELECT batch_id, dirac_id, {r('1.0 / count(*) OVER (PARTITION BY batch_id)')} AS mass FROM d")
def dirac_default_mass(spark, sf_dir):
    return measures.normalize_diracs(line_diracs(spark, sf_dir), 1.0, None).select("batch_id", "dirac_id", rounded("mass").alias("mass"))


@query(f"WITH d AS ({LINE.format(mass='1')}) SELECT batch_id, CAST(greatest(0, least(9, floor(x / 0.1))) AS BIGINT) AS piece, count(*)::DOUBLE AS y0 FROM d GROUP BY ALL")
def grid_hist_1d(spark, sf_dir):
    return measures.histogram_1d(line_diracs(spark, sf_dir), 10).select("batch_id", "piece", "y0")


_GRID = f"""points AS ({POINTS}), g AS (SELECT CAST(greatest(0, least(4, floor(px / 0.2))) AS INTEGER) AS i, CAST(greatest(0, least(3, floor(py / 0.25))) AS INTEGER) AS j, count(*)::DOUBLE AS n FROM points GROUP BY ALL)"""


def point_grid(spark, sf_dir):
    return measures.histogram_grid(line_points(spark, sf_dir), (5, 4), (0.0, 0.0), (1.0, 1.0))


@query(f"WITH {_GRID} SELECT i, j, n FROM g")
def grid_hist_2d(spark, sf_dir):
    return point_grid(spark, sf_dir).select(F.get("idx", F.lit(0)).alias("i"), F.get("idx", F.lit(1)).alias("j"), F.get("coeffs", F.lit(0)).alias("n"))


@query(f"WITH {_GRID} SELECT 0::BIGINT AS batch_id, {r('sum(n * 0.05)')} AS mass FROM g")
def grid_mass(spark, sf_dir):
    return measures.grid_mass(point_grid(spark, sf_dir), 0, 2).select("batch_id", rounded("mass").alias("mass"))


@query(f"WITH {_GRID} SELECT i, j, {r('3 * n / (sum(n) OVER () * 0.05)')} AS c FROM g")
def grid_normalize(spark, sf_dir):
    grid = measures.normalize_grid(point_grid(spark, sf_dir), 0, 2, 3.0)
    return grid.select(F.get("idx", F.lit(0)).alias("i"), F.get("idx", F.lit(1)).alias("j"), rounded(F.get("coeffs", F.lit(0))).alias("c"))


@query(f"""SELECT CAST(p_partkey AS BIGINT) AS batch_id,
{r('a * w * h + b * w * (h * h + 2 * h * y) / 2 + c * (w * w + 2 * w * x) / 2 * h + d * (w * w + 2 * w * x) / 2 * (h * h + 2 * h * y) / 2')} AS mass
FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x, 0.25::DOUBLE AS y, 0.5::DOUBLE AS w, 0.75::DOUBLE AS h, 1.0::DOUBLE AS a, p_size / 10.0::DOUBLE AS b, 2.0::DOUBLE AS c, -0.5::DOUBLE AS d FROM part)""")
def grid_piece_integral_q1(spark, sf_dir):
    x = F.col("p_size") / 50.0
    lo, hi = F.array(x, F.lit(0.25)), F.array(x + 0.5, F.lit(1.0))
    coeffs = F.array(F.lit(1.0), F.col("p_size") / 10.0, F.lit(2.0), F.lit(-0.5))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("batch_id"), lo.alias("lo"), hi.alias("hi"), coeffs.alias("coeffs"))
    return measures.grid_mass(rows, 1, 2).select("batch_id", rounded("mass").alias("mass"))


@query(f"""WITH {_GRID} SELECT point_id, coalesce(n, 0) AS density FROM points LEFT JOIN g ON i = CASE WHEN px < 1 THEN floor(px * 5 + 1e-9) ELSE 5 END AND j = CASE WHEN py < 1 THEN floor(py * 4 + 1e-9) ELSE 4 END""")
def grid_eval_points(spark, sf_dir):
    shift = F.transform("pos", lambda x: F.when(x < 1, x + 1e-10).otherwise(F.lit(1.0)))
    points = line_points(spark, sf_dir).withColumn("pos", shift)
    axes = [[k / 5 for k in range(6)], [k / 4 for k in range(5)]]
    return measures.evaluate_grid(points, point_grid(spark, sf_dir), axes, 0).select("point_id", "density")


@query(f"WITH {_AFFINE} SELECT batch_id, CAST(piece AS BIGINT) AS piece, {r('c1 - c')} AS c0, {r('c1')} AS c1 FROM kc")
def cdf_1d(spark, sf_dir):
    return measures.cdf(measures.affine_pieces(knots(spark, sf_dir, AFFINE_KNOTS, AFFINE_VALUES))).select("batch_id", "piece", rounded("c0").alias("c0"), rounded("c1").alias("c1"))


@query(f"""WITH {_AFFINE}, asked AS (SELECT (i + 1) / 16.0::DOUBLE AS q FROM range(16) t(i))
SELECT kc.batch_id, q, {r('x0 + 2 * (q - (c1 - c)) / (y0 + sqrt(greatest(0, y0 * y0 + 2 * s * (q - (c1 - c)))))')} AS x FROM kc, asked WHERE q > c1 - c + 1e-12 AND q <= c1 + 1e-12""")
def quantile_1d(spark, sf_dir):
    pieces = measures.affine_pieces(knots(spark, sf_dir, AFFINE_KNOTS, AFFINE_VALUES))
    asked = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: k / 16.0)
    return measures.quantiles(pieces, pieces.select("batch_id").distinct().select("batch_id", F.explode(asked).alias("q"))).select("batch_id", "q", rounded("x").alias("x"))


_SPLINE = "SELECT CAST(l_suppkey AS BIGINT) AS batch_id, l_linenumber AS i, CAST(l_linenumber AS DOUBLE) AS x, avg(l_quantity) AS y FROM lineitem GROUP BY ALL"


def line_knots(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("batch_id"), F.col("l_linenumber").cast("long").alias("i")).agg(F.avg("l_quantity").alias("y")).withColumn("x", F.col("i").cast("double"))


@query(f"""SELECT batch_id, CAST(i AS BIGINT) AS piece, {r('y - (y1 - y) / (x1 - x) * x')} AS c0, {r('(y1 - y) / (x1 - x)')} AS c1
FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ({_SPLINE}) WINDOW w AS (PARTITION BY batch_id ORDER BY i)) WHERE x1 IS NOT NULL""")
def spline_c0_coeffs(spark, sf_dir):
    c = F.col("coeffs")
    return measures.spline_c0(line_knots(spark, sf_dir)).select("batch_id", "piece", rounded(F.get(c, F.lit(0))).alias("c0"), rounded(F.get(c, F.lit(1))).alias("c1"))


@query(None)
def spline_c1_coeffs(spark, sf_dir):
    c = F.col("coeffs")
    return measures.spline_c1(line_knots(spark, sf_dir)).select("batch_id", "piece", *[rounded(F.get(c, F.lit(k))).alias(f"c{k}") for k in range(4)])


@query(f"SELECT i, {r('(i / 7.0::DOUBLE) * 3 + 2')} AS x FROM range(8) t(i)")
def linspace(spark, sf_dir):
    return measures.linspace(spark, 2.0, 5.0, 8).select("i", rounded("x").alias("x"))


# Discrete power diagrams.


def assigned(spark, sf_dir):
    return power.assign(line_points(spark, sf_dir), part_sites(spark, sf_dir), ["point_id"])


def cell_sums(spark, sf_dir):
    return power.assigned_sums(assigned(spark, sf_dir), part_sites(spark, sf_dir), 2)


@query(f"WITH {ASSIGNED} SELECT point_id, site_id, {r('cost')} AS cost FROM best")
def power_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("point_id", "site_id", rounded("cost").alias("cost"))


@query(f"WITH {ASSIGNED} SELECT s.site_id, count(b.point_id)::DOUBLE AS cell_mass FROM sites s LEFT JOIN best b ON s.site_id = b.site_id GROUP BY ALL")
def power_cell_mass(spark, sf_dir):
    return cell_sums(spark, sf_dir).select("site_id", "cell_mass")


@query(f"WITH {ASSIGNED} SELECT s.site_id, {r('avg(px)')} AS bx, {r('avg(py)')} AS by FROM sites s LEFT JOIN best b ON s.site_id = b.site_id GROUP BY ALL")
def power_cell_barycenter(spark, sf_dir):
    return cell_sums(spark, sf_dir).select("site_id", rounded("barycenter_0").alias("bx"), rounded("barycenter_1").alias("by"))


@query(f"WITH {ASSIGNED} SELECT s.site_id, {r('coalesce(sum(cost + w), 0)')} AS second_moment FROM sites s LEFT JOIN best b ON s.site_id = b.site_id GROUP BY ALL")
def power_second_moment(spark, sf_dir):
    return cell_sums(spark, sf_dir).select("site_id", rounded("second_moment").alias("second_moment"))


@query(f"WITH {ASSIGNED} SELECT {r('(SELECT avg(cost) FROM best) + (SELECT avg(w) FROM sites)')} AS dual")
def power_dual(spark, sf_dir):
    return power.dual_value(assigned(spark, sf_dir), part_sites(spark, sf_dir), F.lit(1.0)).select(rounded("dual").alias("dual"))


@query(f"""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS v, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
m AS (SELECT label, i, avg(x[i]) AS m FROM e, range(1, 65) t(i) GROUP BY ALL), s AS (SELECT label, list(m ORDER BY i) AS x FROM m GROUP BY label),
c AS (SELECT e.v AS point_id, s.label AS site_id, list_sum(list_transform(range(1, 65), lambda i: (e.x[i] - s.x[i]) * (e.x[i] - s.x[i]))) AS cost FROM e, s)
SELECT point_id, site_id, {r('cost')} AS cost FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY cost, site_id) AS k FROM c) WHERE k = 1""")
def power_assign_64d(spark, sf_dir):
    """All embeddings assigned to the centroids of the labels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("point_id"), F.col("label").cast("long").alias("site_id"), F.transform("embedding", lambda x: x.cast("double")).alias("pos"))
    means = rows.select("site_id", F.posexplode("pos").alias("i", "x")).groupBy("site_id", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("pos"))
    zero = F.lit(0).cast("long").alias("batch_id")
    sites = centres.select(zero, "site_id", "pos", F.lit(0.0).alias("weight"))
    return power.assign(rows.select(zero, "point_id", "pos"), sites, ["point_id"]).select("point_id", "site_id", rounded("cost").alias("cost"))


@query(f"""WITH s AS ({SITES}) SELECT a.site_id AS site0, b.site_id AS site1, {r('b.sx - a.sx')} AS nx, {r('b.sy - a.sy')} AS ny,
{r('a.sx * (b.sx - a.sx) + a.sy * (b.sy - a.sy) + ((b.sx - a.sx) ** 2 + (b.sy - a.sy) ** 2 + a.w - b.w) / 2')} AS "offset" FROM s a JOIN s b ON a.site_id <> b.site_id""")
def bisector_planes(spark, sf_dir):
    s = part_sites(spark, sf_dir)
    a = s.select("batch_id", F.col("site_id").alias("site0"), F.col("pos").alias("pos0"), F.col("weight").alias("weight0"))
    b = s.select("batch_id", F.col("site_id").alias("site1"), F.col("pos").alias("pos1"), F.col("weight").alias("weight1"))
    rows = power.bisectors(a.join(b, "batch_id").where("site0 <> site1"))
    return rows.select("site0", "site1", rounded(F.get("normal", F.lit(0))).alias("nx"), rounded(F.get("normal", F.lit(1))).alias("ny"), rounded("offset").alias("offset"))


@query(f"""WITH p AS ({POINTS}), h AS (SELECT greatest(0, least(255, floor((px - lo) / (hi - lo) * 256))) AS bin, count(*) AS n FROM p, (SELECT min(px) AS lo, max(px) AS hi FROM p) GROUP BY ALL)
SELECT CAST(bin AS BIGINT) AS bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS below FROM h""")
def bsp_histogram_split(spark, sf_dir):
    return power.axis_histogram(line_points(spark, sf_dir), 0)


@query(f"WITH s AS ({SITES}) SELECT count(*) AS n, min(sx) AS x0, min(sy) AS y0, max(sx) AS x1, max(sy) AS y1 FROM s")
def bsp_bbox(spark, sf_dir):
    box = power.bounding_box(part_sites(spark, sf_dir), 2)
    return box.select("n", *[F.get(c, F.lit(d)).alias(n) for c, d, n in (("lo", 0, "x0"), ("lo", 1, "y0"), ("hi", 0, "x1"), ("hi", 1, "y1"))])


@query(None)
def bsp_tree(spark, sf_dir):
    _, nodes = power.spatial_tree(line_points(spark, sf_dir).select("point_id", "pos"), 2, leaf=2000, max_depth=12)
    return nodes.select("node", "n", F.get("lo", F.lit(0)).alias("x0"), F.get("hi", F.lit(0)).alias("x1"), F.get("lo", F.lit(1)).alias("y0"), F.get("hi", F.lit(1)).alias("y1"))


@query(f"""WITH s AS ({SITES}) SELECT 0::BIGINT AS node, {r('sum(sx)')} AS s01, {r('sum(sx * sy)')} AS s12, {r('sum(sx * sx)')} AS s11, {r('sum(w * sx)')} AS r1 FROM s""")
def normal_equations(spark, sf_dir):
    sums = power.weight_bound(part_sites(spark, sf_dir).withColumnRenamed("batch_id", "node"), 2)
    return sums.select("node", *[rounded(c).alias(c) for c in ("s01", "s12", "s11", "r1")])


@query(f"""SELECT CAST(l_suppkey AS BIGINT) AS batch_id, CAST(l_linenumber AS BIGINT) AS row, CAST(l_partkey % 7 AS BIGINT) AS col, {r('sum(l_quantity / 50.0::DOUBLE)')} AS val FROM lineitem GROUP BY ALL""")
def matrix_coo_sum(spark, sf_dir):
    terms = table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as bigint) batch_id", "cast(l_linenumber as bigint) row", "cast(l_partkey % 7 as bigint) col", "l_quantity / 50.0D val")
    return power.sum_triplets(terms).select("batch_id", "row", "col", rounded("val").alias("val"))


# Cells as data.

_BOXES = "SELECT CAST(p_partkey AS BIGINT) AS cell_id, p_size / 50.0::DOUBLE AS sx, 0.25::DOUBLE + (p_partkey % 5) AS sy FROM part"


def boxes(spark, sf_dir):
    """Boxes from the origin: one per part, with four planes each."""
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) cell_id", "p_size / 50.0D sx", "0.25D + (p_partkey % 5) sy")


@query(f"SELECT cell_id, v AS corner, {r('sx * (v & 1)')} AS x, {r('sy * (v >> 1)')} AS y FROM ({_BOXES}), range(4) t(v)")
def cell_box_vertices(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("cell_id", F.posexplode(cells.box_corners([F.col("sx"), F.col("sy")])).alias("corner", "p"))
    return rows.select("cell_id", F.col("corner").cast("long").alias("corner"), rounded(F.get("p", F.lit(0))).alias("x"), rounded(F.get("p", F.lit(1))).alias("y"))


@query(f"SELECT cell_id, {r('sx * sy')} AS measure, {r('sx / 2')} AS cx, {r('sy / 2')} AS cy FROM ({_BOXES})")
def cell_measure_box(spark, sf_dir):
    corners = cells.box_corners([F.col("sx"), F.col("sy")])
    rows = boxes(spark, sf_dir).select("cell_id", F.array(*[F.get(corners, F.lit(k)) for k in (0, 1, 3, 2)]).alias("p"))
    xs, ys = cells.axis_values(F.col("p"), 0), cells.axis_values(F.col("p"), 1)
    return rows.select("cell_id", rounded(arrays.shoelace(xs, ys)).alias("measure"), rounded(arrays.total(xs) / 4).alias("cx"), rounded(arrays.total(ys) / 4).alias("cy"))


def box_planes(spark, sf_dir):
    return boxes(spark, sf_dir).select("cell_id", cells.box_cuts([F.col("sx"), F.col("sy")]).alias("cuts"))


@query(f"SELECT cell_id, i, (0.0 <= sx) AND (i / 10.0::DOUBLE <= sx) AND (0.5 <= sy) AS inside FROM ({_BOXES}), range(11) t(i)")
def cell_contains(spark, sf_dir):
    rows = box_planes(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("i"))
    rows = rows.withColumn("p", F.array(F.col("i") / 10.0, F.lit(0.5)))
    return rows.select("cell_id", "i", cells.contains(F.col("cuts"), F.col("p")).alias("inside"))


@query(f"SELECT cell_id, CAST((0.3 > 0) AS INTEGER) * CASE WHEN sx * 1.0 + 0 - 0.3 > 0 THEN 2 ELSE 0 END AS n_outside, {r('sx - 0.3')} AS farthest FROM ({_BOXES})")
def cell_scalar_products(spark, sf_dir):
    """Signed distances of a box's corners to the plane x = 0.3: how many lie outside, and the largest."""
    corners = cells.box_corners([F.col("sx"), F.col("sy")])
    gaps = boxes(spark, sf_dir).select("cell_id", cells.plane_gaps(corners, F.array(F.lit(1.0), F.lit(0.0)), F.lit(0.3)).alias("gaps"))
    return gaps.select("cell_id", F.size(F.filter("gaps", lambda s: s > 0)).alias("n_outside"), rounded(F.array_max("gaps")).alias("farthest"))


_POLY = "SELECT CAST(p_partkey AS BIGINT) AS cell_id, v, (1 + (p_partkey % 7) / 10.0::DOUBLE) * cos(2 * pi() * v / (3 + p_partkey % 4)) AS x, (1 + p_size / 50.0::DOUBLE) * sin(2 * pi() * v / (3 + p_partkey % 4)) AS y, 3 + p_partkey % 4 AS n FROM part, range(6) t(v) WHERE v < 3 + p_partkey % 4"


def polygons(spark, sf_dir):
    """Counter-clockwise polygons of three to six corners."""
    n = (3 + F.col("p_partkey") % 4).cast("int")
    turn = lambda v: 2 * F.pi() * v / F.col("n")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("cell_id"), n.alias("n"), (1 + (F.col("p_partkey") % 7) / 10.0).alias("a"), (1 + F.col("p_size") / 50.0).alias("b"))
    around = F.sequence(F.lit(0), F.col("n") - 1)
    return rows.select("cell_id", "n", F.transform(around, lambda v: F.col("a") * F.cos(turn(v))).alias("xs"), F.transform(around, lambda v: F.col("b") * F.sin(turn(v))).alias("ys"))


@query(f"""WITH p AS ({_POLY}), e AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x1, coalesce(lead(y) OVER w, first(y) OVER w) AS y1 FROM p WINDOW w AS (PARTITION BY cell_id ORDER BY v))
SELECT cell_id, {r('sum(x * y1 - x1 * y) / 2')} AS area FROM e GROUP BY cell_id""")
def polygon_shoelace(spark, sf_dir):
    return polygons(spark, sf_dir).select("cell_id", rounded(arrays.shoelace(F.col("xs"), F.col("ys"))).alias("area"))


@query(f"""WITH p AS ({_POLY}) SELECT a.cell_id, a.v, {r('(b.y - c.y) / 2')} AS dx, {r('(c.x - b.x) / 2')} AS dy FROM p a JOIN p b ON a.cell_id = b.cell_id AND b.v = (a.v + 1) % a.n JOIN p c ON a.cell_id = c.cell_id AND c.v = (a.v + a.n - 1) % a.n""")
def polygon_shoelace_grad(spark, sf_dir):
    rows = polygons(spark, sf_dir).select("cell_id", F.posexplode(cells.shoelace_gradient(F.col("xs"), F.col("ys"))).alias("v", "g"))
    return rows.select("cell_id", F.col("v").cast("long").alias("v"), rounded("g.dx").alias("dx"), rounded("g.dy").alias("dy"))


@query(f"""WITH p AS ({_POLY}) SELECT a.cell_id, b.v AS k, {r('abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2')} AS area FROM p a JOIN p b ON a.cell_id = b.cell_id AND a.v = 0 AND b.v > 0 JOIN p c ON c.cell_id = a.cell_id AND c.v = b.v + 1""")
def fan_simplices(spark, sf_dir):
    rows = polygons(spark, sf_dir).select("cell_id", F.posexplode(cells.fan_areas(F.col("xs"), F.col("ys"))).alias("k", "area"))
    return rows.select("cell_id", (F.col("k") + 1).cast("long").alias("k"), rounded("area").alias("area"))


@query(f"""WITH p AS ({_POLY}) SELECT a.cell_id, a.v AS k, {r('sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)')} AS length FROM p a JOIN p b ON a.cell_id = b.cell_id AND b.v = (a.v + 1) % a.n""")
def cell_facets(spark, sf_dir):
    rows = polygons(spark, sf_dir).select("cell_id", F.posexplode(cells.polygon_facets(F.col("xs"), F.col("ys"))).alias("k", "length"))
    return rows.select("cell_id", F.col("k").cast("long").alias("k"), rounded("length").alias("length"))


@query(f"SELECT cell_id, {r('sx * sy * 2 - 0.25')} AS det, {r('(2 - 0.5 * sy) / (sx * sy * 2 - 0.25)')} AS x FROM (SELECT cell_id, sx + 1 AS sx, sy FROM ({_BOXES}))")
def matrix_solve_2d(spark, sf_dir):
    """det and first unknown of [[2 sx, 0.5], [0.5, sy]] scaled: rows (sx * 2, 0.5 | 2 / sy ...) solved by determinants."""
    b = boxes(spark, sf_dir).select("cell_id", (F.col("sx") + 1).alias("sx"), "sy")
    m = [[F.col("sx") * 2, F.lit(0.5)], [F.lit(0.5), F.col("sy")]]
    return b.select("cell_id", rounded(arrays.determinant(m)).alias("det"), rounded(arrays.solve(m, [2 / F.col("sy"), F.col("sy")])[0]).alias("x"))


@query("SELECT k AS id, k // 6 AS i, (k // 2) % 3 AS j, k % 2 AS l FROM range(12) t(k)")
def cartesian_index(spark, sf_dir):
    """Row-major multi-index of a 2 x 3 x 2 product."""
    return spark.range(12).select("id", *[c.alias(n) for c, n in zip(cells.multi_index(F.col("id"), [2, 3, 2]), "ijl", strict=True)])


@query("""WITH n AS (SELECT l_suppkey AS b, l_returnflag AS f, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL) SELECT CAST(b AS BIGINT) AS batch_id, count(DISTINCT n) = 1 AS consistent, min(n) AS least, max(n) AS most FROM n GROUP BY b""")
def axis_consistency(spark, sf_dir):
    """Whether columns that share an axis have equal lengths in every batch."""
    lengths = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("batch_id"), "l_returnflag").agg(F.countDistinct("l_linenumber").alias("n"))
    return lengths.groupBy("batch_id").agg((F.min("n") == F.max("n")).alias("consistent"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(f"""WITH s AS ({SITES}) SELECT site_id, i AS image, {r('sx + CASE i WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END')} AS x, {r('sy')} AS y FROM s, range(3) t(i)""")
def periodic_replication(spark, sf_dir):
    rows = power.replicate(part_sites(spark, sf_dir), [[1.0, 0.0], [-1.0, 0.0]])
    return rows.select("site_id", F.col("image").cast("long").alias("image"), rounded(F.get("pos", F.lit(0))).alias("x"), rounded(F.get("pos", F.lit(1))).alias("y"))


# Cells of continuous diagrams.  The SQL meets every two cuts of a cell and keeps the points that no cut has outside.

DIAGRAM = f"""s AS MATERIALIZED (SELECT site_id, sx, sy, w * 0.1 AS w FROM ({SITES})),
cuts AS MATERIALIZED (SELECT a.site_id, b.site_id AS cut, b.sx - a.sx AS nx, b.sy - a.sy AS ny, a.sx * (b.sx - a.sx) + a.sy * (b.sy - a.sy) + ((b.sx - a.sx) ** 2 + (b.sy - a.sy) ** 2 + a.w - b.w) / 2 AS o FROM s a JOIN s b ON a.site_id <> b.site_id
  UNION ALL SELECT site_id, v.* FROM s, (VALUES (-1, -1.0, 0.0, 0.0), (-2, 1.0, 0.0, 1.0), (-3, 0.0, -1.0, 0.0), (-4, 0.0, 1.0, 1.0)) v),
met AS (SELECT site_id, a.cut AS cut0, b.cut AS cut1, (a.o * b.ny - b.o * a.ny) / (a.nx * b.ny - a.ny * b.nx) AS x, (a.nx * b.o - b.nx * a.o) / (a.nx * b.ny - a.ny * b.nx) AS y
  FROM cuts a JOIN cuts b USING (site_id) WHERE a.cut < b.cut AND abs(a.nx * b.ny - a.ny * b.nx) > 1e-12),
verts AS MATERIALIZED (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.site_id = m.site_id AND c.nx * m.x + c.ny * m.y > c.o + 1e-9)),
ends AS (SELECT site_id, cut0 AS cut, x, y FROM verts UNION ALL SELECT site_id, cut1, x, y FROM verts),
facets AS MATERIALIZED (SELECT site_id, cut, x0, y0, x1, y1, sx, sy, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS facet, (o - nx * sx - ny * sy) / sqrt(nx * nx + ny * ny) AS gap
  FROM (SELECT site_id, cut, min([x, y])[1] AS x0, min([x, y])[2] AS y0, max([x, y])[1] AS x1, max([x, y])[2] AS y1 FROM ends GROUP BY ALL) JOIN cuts USING (site_id, cut) JOIN s USING (site_id)),
parts AS (SELECT site_id, cut, facet, facet * gap / 2 AS area, ((sx + x0 + x1) ** 2 + (sy + y0 + y1) ** 2 + sx * sx + sy * sy + x0 * x0 + y0 * y0 + x1 * x1 + y1 * y1) / 12 AS spread FROM facets),
integrals AS (SELECT site_id, NULL::BIGINT AS neighbor, sum(area) AS mass, sum(area * spread) AS second, 0.0::DOUBLE AS facet FROM parts GROUP BY site_id
  UNION ALL SELECT site_id, cut, 0.0, 0.0, facet FROM parts WHERE cut >= 0),
terms AS (SELECT i.site_id AS row, neighbor AS col, -facet / (2 * sqrt((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2)) AS val FROM integrals i JOIN s a ON a.site_id = i.site_id JOIN s b ON b.site_id = neighbor)"""


def unit_grid(spark):
    return measures.polynomial_grid(spark, [[[1.0]]])


def small_weight_sites(spark, sf_dir):
    return part_sites(spark, sf_dir).withColumn("weight", F.col("weight") * 0.1)


def diagram(spark, sf_dir):
    return power.cells(small_weight_sites(spark, sf_dir), [0.0, 0.0], [1.0, 1.0])


@query(f"""WITH points AS MATERIALIZED ({POINTS}), {DIAGRAM}, places AS MATERIALIZED (SELECT DISTINCT px, py FROM points),
best AS (SELECT px, py, arg_min(site_id, [(px - sx) ** 2 + (py - sy) ** 2 - w, site_id]) AS site_id FROM places, s GROUP BY ALL),
gaps AS (SELECT px, py, min((o - nx * px - ny * py) / sqrt(nx * nx + ny * ny)) AS gap FROM best JOIN cuts USING (site_id) GROUP BY ALL)
SELECT point_id, {r('gap')} AS distance FROM points JOIN gaps USING (px, py)""")
def boundary_distances(spark, sf_dir):
    found = power.assign(line_points(spark, sf_dir), small_weight_sites(spark, sf_dir), ["point_id"])
    return power.boundary_distances(found, diagram(spark, sf_dir)).select("point_id", rounded("distance").alias("distance"))


@query(f"WITH {DIAGRAM} SELECT site_id, CAST(count(*) AS INTEGER) AS n_points, {r('min(x)')} AS x_min, {r('max(x)')} AS x_max, {r('min(y)')} AS y_min, {r('max(y)')} AS y_max FROM verts GROUP BY site_id")
def vtk_faces(spark, sf_dir):
    """The diagram's polygons, written as VTK files and read back."""
    path = shared_path(spark, "vtk")
    vtk.write_vtk(vtk.cell_faces(diagram(spark, sf_dir), 2), path)
    rows = vtk.read_vtk(spark, path)
    x, y = cells.axis_values(F.col("points"), 0), cells.axis_values(F.col("points"), 1)
    ends = [rounded(f(c)).alias(f"{n}_{e}") for c, n in ((x, "x"), (y, "y")) for f, e in ((F.array_min, "min"), (F.array_max, "max"))]
    return rows.select("site_id", F.size("points").alias("n_points"), *ends)


@query(f"""WITH {DIAGRAM}, n AS (SELECT site_id, count(*) AS n FROM verts GROUP BY ALL), k AS (SELECT site_id, count(DISTINCT cut) AS k FROM ends GROUP BY ALL)
SELECT site_id, TRUE AS is_closed, CAST(coalesce(n, 0) AS INTEGER) AS n_vertices, CAST(coalesce(k, 0) AS INTEGER) AS n_cuts FROM s LEFT JOIN n USING (site_id) LEFT JOIN k USING (site_id)""")
def cell_clip(spark, sf_dir):
    rows = diagram(spark, sf_dir)
    return rows.select("site_id", "is_closed", F.size("vertices").alias("n_vertices"), F.size("cut_ids").alias("n_cuts"))


@query(f"WITH {DIAGRAM} SELECT site_id, neighbor, {r('mass')} AS mass, {r('second')} AS second, {r('facet')} AS facet FROM integrals")
def cell_integrals(spark, sf_dir):
    sums = power.cell_integrals(diagram(spark, sf_dir), unit_grid(spark), [[0.0, 1.0]] * 2, 0)
    return sums.select("site_id", "neighbor", rounded("mass").alias("mass"), rounded("second").alias("second"), rounded("facet").alias("facet"))


@query(f"WITH {DIAGRAM}, e AS (SELECT row, col, val FROM terms UNION ALL SELECT row, row, -val FROM terms) SELECT row, col, {r('sum(val)')} AS val FROM e GROUP BY row, col")
def newton_matrix(spark, sf_dir):
    sums = power.cell_integrals(diagram(spark, sf_dir), unit_grid(spark), [[0.0, 1.0]] * 2, 0)
    return power.matrix_terms(sums, part_sites(spark, sf_dir)).select("row", "col", rounded("val").alias("val"))


@query(f"WITH s AS ({SITES}) SELECT site_id, {r('1.0 / count(*) OVER ()')} AS mass FROM s")
def newton_plan(spark, sf_dir):
    """Masses of the cells under the weights found: all sites get the same."""
    plans = solver.solve_plans(part_sites(spark, sf_dir).withColumn("mass", F.lit(1.0)), unit_grid(spark), [[0.0, 1.0]] * 2, tol=1e-6)
    return plans.rows.select("site_id", rounded("mass").alias("mass"))


_LLOYD = "a{k} AS (SELECT px, py, n, arg_min(site_id, [(px - sx) ** 2 + (py - sy) ** 2, site_id]) AS site_id FROM places, s{i} GROUP BY ALL), s{k} AS MATERIALIZED (SELECT s{i}.site_id, coalesce(sum(n * px) / sum(n), any_value(sx)) AS sx, coalesce(sum(n * py) / sum(n), any_value(sy)) AS sy FROM s{i} LEFT JOIN a{k} USING (site_id) GROUP BY ALL)"


@query(f"""WITH places AS MATERIALIZED (SELECT px, py, count(*) AS n FROM ({POINTS}) GROUP BY ALL), s0 AS MATERIALIZED (SELECT site_id, sx, sy FROM ({SITES})), {", ".join(_LLOYD.format(i=k - 1, k=k) for k in (1, 2, 3))}
SELECT site_id, {r('sx')} AS x, {r('sy')} AS y FROM s3""")
def lloyd_points(spark, sf_dir):
    sites = part_sites(spark, sf_dir).withColumn("weight", F.lit(0.0))
    rows = solver.lloyd_discrete(line_points(spark, sf_dir), sites, 2, 3)
    return rows.select("site_id", rounded(F.get("pos", F.lit(0))).alias("x"), rounded(F.get("pos", F.lit(1))).alias("y"))


# Diagrams of one site a part, which grow with the table.  The SQL meets the cuts of sites within four mean distances, which is farther than any cell reaches.


SQUARE = ((-1.0, 0.0, 0.0), (1.0, 0.0, 1.0), (0.0, -1.0, 0.0), (0.0, 1.0, 1.0))


def part_diagram(weight: str = "0.00001::DOUBLE * (p_size % 7)", torus: bool = False, walls=SQUARE) -> str:
    images = "SELECT s.*, (i + 1) * 3 + j + 1 AS image, i AS ix, j AS iy FROM s, range(-1, 2) a(i), range(-1, 2) b(j)" if torus else "SELECT s.*, 4 AS image, 0 AS ix, 0 AS iy FROM s"
    planes = ", ".join(f"({-k}, {x}::DOUBLE, {y}::DOUBLE, {o}::DOUBLE)" for k, (x, y, o) in enumerate(walls, 1))
    walls = "" if torus else f"UNION ALL SELECT site_id, v.*, 0, 0 FROM s, (VALUES {planes}) v"
    return f"""n AS MATERIALIZED (SELECT count(*) AS n FROM part),
s AS MATERIALIZED (SELECT CAST(p_partkey AS BIGINT) AS site_id, (p_partkey * 0.7548776662466927::DOUBLE) % 1.0::DOUBLE AS sx, (p_partkey * 0.5698402909980532::DOUBLE) % 1.0::DOUBLE AS sy, {weight} AS w FROM part, n),
images AS MATERIALIZED ({images}),
cuts AS MATERIALIZED (SELECT a.site_id, b.site_id * 9 + image AS cut, b.sx + ix - a.sx AS nx, b.sy + iy - a.sy AS ny,
    a.sx * (b.sx + ix - a.sx) + a.sy * (b.sy + iy - a.sy) + ((b.sx + ix - a.sx) ** 2 + (b.sy + iy - a.sy) ** 2 + a.w - b.w) / 2 AS o, ix, iy
  FROM s a, images b, n WHERE NOT (a.site_id = b.site_id AND image = 4) AND (b.sx + ix - a.sx) ** 2 + (b.sy + iy - a.sy) ** 2 < 16.0 / n {walls}),
met AS (SELECT site_id, a.cut AS cut0, b.cut AS cut1, (a.o * b.ny - b.o * a.ny) / (a.nx * b.ny - a.ny * b.nx) AS x, (a.nx * b.o - b.nx * a.o) / (a.nx * b.ny - a.ny * b.nx) AS y
  FROM cuts a JOIN cuts b USING (site_id) WHERE a.cut < b.cut AND abs(a.nx * b.ny - a.ny * b.nx) > 1e-12),
verts AS MATERIALIZED (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.site_id = m.site_id AND c.nx * m.x + c.ny * m.y > c.o + 1e-11)),
ends AS (SELECT site_id, cut0 AS cut, x, y FROM verts UNION ALL SELECT site_id, cut1, x, y FROM verts),
edges AS MATERIALIZED (SELECT site_id, cut, CASE WHEN cut >= 0 THEN cut // 9 END AS neighbor, ix, iy, x0, y0, x1, y1, sx, sy, w, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS facet,
    (o - nx * sx - ny * sy) / sqrt(nx * nx + ny * ny) AS gap, nx / sqrt(nx * nx + ny * ny) AS ux, ny / sqrt(nx * nx + ny * ny) AS uy, sqrt(nx * nx + ny * ny) AS apart
  FROM (SELECT site_id, cut, min([x, y])[1] AS x0, min([x, y])[2] AS y0, max([x, y])[1] AS x1, max([x, y])[2] AS y1 FROM ends GROUP BY ALL) JOIN cuts USING (site_id, cut) JOIN s USING (site_id)),
parts AS MATERIALIZED (SELECT *, facet * gap / 2 AS area, ((sx + x0 + x1) ** 2 + (sy + y0 + y1) ** 2 + sx * sx + sy * sy + x0 * x0 + y0 * y0 + x1 * x1 + y1 * y1) / 12 AS spread FROM edges),
wholes AS MATERIALIZED (SELECT site_id, sum(area) AS mass, sum(area * (sx + x0 + x1) / 3) AS fx, sum(area * (sy + y0 + y1) / 3) AS fy, sum(area * spread) AS second FROM parts GROUP BY site_id)"""


def part_cells(spark, sf_dir, torus=False):
    return power.cells(part_points(spark, sf_dir), [0.0, 0.0], [1.0, 1.0], [torus, torus])


def part_integrals(spark, sf_dir, torus=False):
    return power.cell_integrals(part_cells(spark, sf_dir, torus), unit_grid(spark), [[0.0, 1.0]] * 2, 0, [torus, torus])


@query(f"""WITH places AS MATERIALIZED (SELECT DISTINCT px, py FROM ({POINTS})), {part_diagram()},
best AS (SELECT px, py, arg_min(site_id, [(px - sx) * (px - sx) + (py - sy) * (py - sy) - w, site_id]) AS site_id, min((px - sx) * (px - sx) + (py - sy) * (py - sy) - w) AS cost FROM places, s GROUP BY ALL)
SELECT point_id, site_id, {r('cost * 1000')} AS cost FROM ({POINTS}) JOIN best USING (px, py)""")
def part_assign(spark, sf_dir):
    """Line items assigned to one site a part: more sites than travel with a task, but for the smallest table."""
    found = power.assign(line_points(spark, sf_dir), part_points(spark, sf_dir))
    return found.select("point_id", "site_id", rounded(F.col("cost") * 1000).alias("cost"))


#: A quarter turn about the square's centre, and the mirror image across the vertical line through it.
TURN_AND_MIRROR = [[[0.0, -1.0, 1.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [[-1.0, 0.0, 1.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]]


@query(f"""WITH points AS ({POINTS}), sites AS ({SITES}),
images AS (SELECT sx, sy, w FROM sites UNION ALL SELECT 1 - sy, sx, w FROM sites UNION ALL SELECT 1 - sx, sy, w FROM sites),
best AS (SELECT rid, point_id, min((px - sx) * (px - sx) + (py - sy) * (py - sy) - w) AS cost FROM points, images GROUP BY ALL)
SELECT point_id, {r('cost')} AS cost FROM best""")
def image_assign(spark, sf_dir):
    """Line items assigned to the sites of part_sites, or to their images by a turn and a mirror."""
    found = power.assign_images(line_points(spark, sf_dir), part_sites(spark, sf_dir), TURN_AND_MIRROR)
    return found.select("point_id", rounded("cost").alias("cost"))


_INTEGRALS = f"""SELECT site_id, NULL::BIGINT AS neighbor, NULL::INTEGER AS ix, NULL::INTEGER AS iy, {r('mass * 1000')} AS mass, {r('fx * 1000')} AS fx, {r('fy * 1000')} AS fy, {r('second * 1000')} AS second, 0.0::DOUBLE AS facet FROM wholes
UNION ALL SELECT site_id, neighbor, CAST(ix AS INTEGER), CAST(iy AS INTEGER), 0.0, 0.0, 0.0, 0.0, {r('facet * 10')} FROM edges WHERE neighbor IS NOT NULL AND facet > 1e-7"""


def integral_rows(sums):
    rows = sums.where("neighbor is null or facet > 1e-7")
    moved = [F.round(F.get("shift", F.lit(d))).cast("int").alias(n) for d, n in ((0, "ix"), (1, "iy"))]
    first = [rounded(F.get("first", F.lit(d)) * 1000).alias(n) for d, n in ((0, "fx"), (1, "fy"))]
    return rows.select("site_id", "neighbor", *moved, rounded(F.col("mass") * 1000).alias("mass"), *first, rounded(F.col("second") * 1000).alias("second"), rounded(F.col("facet") * 10).alias("facet"))


@query(f"WITH {part_diagram()} {_INTEGRALS}")
def part_cell_integrals(spark, sf_dir):
    return integral_rows(part_integrals(spark, sf_dir))


@query(f"WITH {part_diagram(torus=True)} {_INTEGRALS}")
def torus_cell_integrals(spark, sf_dir):
    """Cells of the torus: neighbours are keyed by image, and nothing ends at the square's sides."""
    return integral_rows(part_integrals(spark, sf_dir, torus=True))


@query(f"""WITH {part_diagram(torus=True)}, e AS (SELECT site_id AS row, neighbor AS col, -facet / (2 * apart) AS val FROM edges WHERE neighbor <> site_id)
SELECT row, col, {r('sum(val)')} AS val FROM (SELECT * FROM e UNION ALL SELECT row, row, -val FROM e) GROUP BY row, col HAVING abs(sum(val)) > 1e-5""")
def torus_newton_matrix(spark, sf_dir):
    terms = power.matrix_terms(part_integrals(spark, sf_dir, torus=True), part_points(spark, sf_dir))
    return terms.where("abs(val) > 1e-5").select("row", "col", rounded("val").alias("val"))


_BALLS = f"""WITH {part_diagram("0.00001::DOUBLE * (p_size % 7) * 5000 / n + 0.25 / n")},
tangents AS (SELECT *, sqrt(w) AS r, sqrt(greatest(0, w - gap * gap)) AS h, least((x0 - sx) * -uy + (y0 - sy) * ux, (x1 - sx) * -uy + (y1 - sy) * ux) AS u0, greatest((x0 - sx) * -uy + (y0 - sy) * ux, (x1 - sx) * -uy + (y1 - sy) * ux) AS u1 FROM edges),
clipped AS (SELECT *, greatest(-h, least(h, u0)) AS a, greatest(-h, least(h, u1)) AS b FROM tangents),
turned AS (SELECT *, CASE WHEN gap = 0 THEN 0 ELSE atan(a / gap) - atan(u0 / gap) + atan(u1 / gap) - atan(b / gap) END AS turn FROM clipped),
balls AS MATERIALIZED (SELECT *, gap * (b - a) / 2 + w * turn / 2 AS area FROM turned)"""


def ball_integrals(spark, sf_dir):
    sites = part_balls(spark, sf_dir)
    return power.cell_integrals(power.cells(sites, [0.0, 0.0], [1.0, 1.0]), unit_grid(spark), [[0.0, 1.0]] * 2, 0, balls=True)


@query(f"""{_BALLS} SELECT site_id, NULL::BIGINT AS neighbor, {r('sum(area) * 1000')} AS mass, {r('sum(r * turn) * 10')} AS arc, 0.0::DOUBLE AS facet FROM balls GROUP BY site_id HAVING sum(area) > 1e-9
UNION ALL SELECT site_id, neighbor, 0.0, 0.0, {r('(b - a) * 10')} FROM balls WHERE neighbor IS NOT NULL AND b - a > 1e-7""")
def ball_cell_integrals(spark, sf_dir):
    """Cells cut by balls, as partial transport has them: masses, arcs, and what of each facet is in the ball."""
    rows = ball_integrals(spark, sf_dir).where("mass > 1e-9 or facet > 1e-7")
    return rows.select("site_id", "neighbor", rounded(F.col("mass") * 1000).alias("mass"), rounded(F.col("arc") * 10).alias("arc"), rounded(F.col("facet") * 10).alias("facet"))


@query(f"""{_BALLS}, e AS (SELECT site_id AS row, neighbor AS col, -(b - a) / (2 * apart) AS val FROM balls WHERE neighbor IS NOT NULL), d AS (SELECT site_id AS row, site_id AS col, sum(r * turn) / (2 * sqrt(any_value(w))) AS val FROM balls GROUP BY site_id)
SELECT row, col, {r('sum(val)')} AS val FROM (SELECT * FROM e UNION ALL SELECT row, row, -val FROM e UNION ALL SELECT * FROM d) GROUP BY row, col HAVING abs(sum(val)) > 1e-5""")
def ball_newton_matrix(spark, sf_dir):
    terms = power.matrix_terms(ball_integrals(spark, sf_dir), part_balls(spark, sf_dir))
    return terms.where("abs(val) > 1e-5").select("row", "col", rounded("val").alias("val"))


_DERIVATIVES = f"""WITH {part_diagram()},
m AS (SELECT site_id, neighbor, apart, facet AS f, facet * (x0 + x1) / 2 AS mx, facet * (y0 + y1) / 2 AS my, facet * (x0 * x0 + x0 * x1 + x1 * x1) / 3 AS mxx, facet * (y0 * y0 + y0 * y1 + y1 * y1) / 3 AS myy,
    facet * (2 * x0 * y0 + x0 * y1 + x1 * y0 + 2 * x1 * y1) / 6 AS mxy, sx, sy FROM edges WHERE neighbor IS NOT NULL),
sides AS (SELECT m.*, 1 AS sign, site_id AS col, m.sx AS px, m.sy AS py FROM m UNION ALL SELECT m.*, -1, neighbor, s.sx, s.sy FROM m JOIN s ON s.site_id = neighbor),
grown AS (SELECT site_id, col, col_axis, sign / apart * CASE col_axis WHEN 0 THEN mx - px * f WHEN 1 THEN my - py * f ELSE f / 2 END AS g,
    sign / apart * CASE col_axis WHEN 0 THEN mxx - px * mx WHEN 1 THEN mxy - py * mx ELSE mx / 2 END AS gx, sign / apart * CASE col_axis WHEN 0 THEN mxy - px * my WHEN 1 THEN myy - py * my ELSE my / 2 END AS gy FROM sides, range(3) t(col_axis)),
summed AS (SELECT site_id, col, col_axis, sum(g) AS g, sum(gx) AS gx, sum(gy) AS gy FROM grown GROUP BY ALL),
triplets AS (SELECT site_id AS row, row_axis, col, col_axis, CASE row_axis WHEN 0 THEN (gx - fx / mass * g) / mass WHEN 1 THEN (gy - fy / mass * g) / mass ELSE g END AS val FROM summed JOIN wholes USING (site_id), range(3) t(row_axis))
SELECT row, CAST(row_axis AS INTEGER) AS row_axis, col, CAST(col_axis AS INTEGER) AS col_axis, """


@query(f"{_DERIVATIVES} {r('val / 1000')} AS val FROM triplets WHERE abs(val) > 1e-4")
def centroid_derivatives(spark, sf_dir):
    """Derivatives of all centroids and masses by all positions and weights."""
    triplets = power.centroid_jacobian(part_integrals(spark, sf_dir), part_points(spark, sf_dir), 2)
    return triplets.where("abs(val) > 1e-4").select("row", "row_axis", "col", "col_axis", rounded(F.col("val") / 1000).alias("val"))


#: An obstacle: a point on each side of a slanted square, and its outward normal.
OBSTACLE = (((0.7, 0.5), (1.0, 0.5)), ((0.5, 0.7), (-0.5, 1.0)), ((0.3, 0.5), (-1.0, -0.5)), ((0.5, 0.3), (0.5, -1.0)))
_OBSTACLE_WALLS = tuple((n[0], n[1], p[0] * n[0] + p[1] * n[1]) for p, n in OBSTACLE)


@query(f"""WITH a AS (WITH {part_diagram()} SELECT site_id, -1 AS cut, mass, fx, fy, 0.0::DOUBLE AS facet FROM wholes UNION ALL SELECT site_id, cut, 0, 0, 0, facet FROM edges WHERE neighbor IS NOT NULL),
b AS (WITH {part_diagram(walls=_OBSTACLE_WALLS)} SELECT site_id, -1 AS cut, mass, fx, fy, 0.0::DOUBLE AS facet FROM wholes UNION ALL SELECT site_id, cut, 0, 0, 0, facet FROM edges WHERE neighbor IS NOT NULL)
SELECT a.site_id, CASE WHEN a.cut >= 0 THEN a.cut // 9 END AS neighbor, {r('(a.mass - coalesce(b.mass, 0)) * 1000')} AS mass, {r('(a.fx - coalesce(b.fx, 0)) * 1000')} AS fx, {r('(a.fy - coalesce(b.fy, 0)) * 1000')} AS fy, {r('(a.facet - coalesce(b.facet, 0)) * 10')} AS facet
FROM a LEFT JOIN b ON a.site_id = b.site_id AND a.cut = b.cut WHERE a.mass - coalesce(b.mass, 0) > 1e-7 OR a.facet - coalesce(b.facet, 0) > 1e-6""")
def obstacle_cell_integrals(spark, sf_dir):
    """Cells of the square around an obstacle: a piece of coefficient -1."""
    box = [((0.0, 0.0), (-1.0, 0.0)), ((1.0, 1.0), (1.0, 0.0)), ((0.0, 0.0), (0.0, -1.0)), ((1.0, 1.0), (0.0, 1.0))]
    rows = [(0, k, [list(p) for p, _ in planes], [list(n) for _, n in planes], c) for k, (planes, c) in enumerate(((box, 1.0), (OBSTACLE, -1.0)))]
    polyhedra = spark.createDataFrame(rows, "batch_id long, piece_id long, points array<array<double>>, normals array<array<double>>, coefficient double")
    sums = power.piece_integrals(part_cells(spark, sf_dir), measures.convex_pieces(polyhedra, 2), 2).where("mass > 1e-7 or facet > 1e-6")
    first = [rounded(F.get("first", F.lit(d)) * 1000).alias(n) for d, n in ((0, "fx"), (1, "fy"))]
    return sums.select("site_id", "neighbor", rounded(F.col("mass") * 1000).alias("mass"), *first, rounded(F.col("facet") * 10).alias("facet"))


@query(None)
def image_targets(spark, sf_dir):
    """Where the pixels of an image of the line items go: masses and targets of the boxes of a 6 x 4 grid."""
    knots = [[k / 6 for k in range(7)], [k / 4 for k in range(5)]]
    counts = measures.histogram_grid(line_points(spark, sf_dir), [6, 4], [0.0, 0.0], [1.0, 1.0])
    rows = power.image_integrals(part_cells(spark, sf_dir), counts, knots)
    places = [F.get("idx", F.lit(d)).alias(n) for d, n in ((0, "i"), (1, "j"))]
    return rows.select(*places, rounded("mass").alias("mass"), *[rounded(F.get("target", F.lit(d))).alias(n) for d, n in ((0, "tx"), (1, "ty"))])


_AXES = f"""WITH p AS (SELECT CAST(l_suppkey AS BIGINT) + 1 AS node, l_quantity / 50.0::DOUBLE AS x, l_discount * 10.0::DOUBLE AS y FROM lineitem),
c AS (SELECT node, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(y, y) AS cyy FROM p GROUP BY node),
a AS (SELECT *, atan2(2 * cxy, cxx - cyy) / 2 AS turn, (cxx + cyy) / 2 + sqrt(((cxx - cyy) / 2) ** 2 + cxy * cxy) AS spread FROM c)"""


def supplier_points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as bigint) + 1 node", "array(l_quantity / 50.0D, l_discount * 10.0D) pos")


@query(f"{_AXES} SELECT node, n, {r('mx')} AS mx, {r('my')} AS my, {r('cxx')} AS cxx, {r('cxy')} AS cxy, {r('cyy')} AS cyy, {r('abs(cos(turn))')} AS ax, {r('abs(sin(turn))')} AS ay, {r('spread')} AS spread FROM a")
def node_principal_axes(spark, sf_dir):
    """Mean, covariance and leading axis of every supplier's line items."""
    rows = power.principal_axes(supplier_points(spark, sf_dir), 2)
    cells_ = [("mean", 0, "mx"), ("mean", 1, "my"), ("covariance", 0, "cxx"), ("covariance", 1, "cxy"), ("covariance", 3, "cyy")]
    axis = [rounded(F.abs(F.get("axis", F.lit(d)))).alias(n) for d, n in ((0, "ax"), (1, "ay"))]
    return rows.select("node", "n", *[rounded(F.get(c, F.lit(k))).alias(n) for c, k, n in cells_], *axis, rounded("spread").alias("spread"))


@query(f"""{_AXES}, s AS (SELECT node * 2 + CASE WHEN sign(cos(turn)) * (cos(turn) * (x - mx) + sin(turn) * (y - my)) > 0 THEN 1 ELSE 0 END AS node, x FROM p JOIN a USING (node))
SELECT node, count(*) AS n, {r('avg(x)')} AS mx FROM s GROUP BY node""")
def node_axis_split(spark, sf_dir):
    """Every supplier's line items, split across the mean along their leading axis."""
    rows = power.split_by_axes(supplier_points(spark, sf_dir), 2)
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.get("pos", F.lit(0)))).alias("mx"))


@query(None)
def spline_c1_value_gradients(spark, sf_dir):
    """Gradients of the sum of all coefficients of the suppliers' splines by their values."""
    knots_ = line_knots(spark, sf_dir)
    ones = measures.spline_c1(knots_).select("batch_id", "piece", F.array(*[F.lit(1.0)] * 4).alias("coeffs"))
    return measures.spline_c1_gradients(knots_, ones).select("batch_id", "i", rounded("d_y").alias("d_y"))

"""Regression, predictor selection and cross-validated learners on line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from welfarelens.operators import encode as E, policy as P, regress as R, split as S
from welfarelens.plans import predictors as M
from workloads.registry import query
from workloads.tables import HH, LINE, households, rounded, table, with_

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size"]


def covariates(spark, sf):
    """Line items with the price paid as outcome, a weight and a ready fold column."""
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    joined = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        *NUMBERS,
        *[F.when(F.col("l_returnflag") == v, 1.0).otherwise(0.0).alias(f"flag_{v}") for v in "ANR"],
        *[F.when(F.col("l_linestatus") == v, 1.0).otherwise(0.0).alias(f"line_{v}") for v in "OF"],
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 1024).alias("outcome"),
        (F.lit(1.0) + F.col("l_linenumber") / 8.0).alias("hh_wgt"),
        (F.col("l_linenumber") - 1).alias("fold"),
        "l_returnflag",
    )


COV = """cov AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, p_size::DOUBLE AS p_size,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1024 AS outcome, 1.0::DOUBLE + l_linenumber / 8.0::DOUBLE AS hh_wgt,
  l_linenumber - 1 AS fold, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CANDIDATES = {
    "quantity": ["l_quantity"], "price": ["l_extendedprice"], "discount": ["l_discount"], "tax": ["l_tax"],
    "size": ["p_size"], "flag": ["flag_A", "flag_N", "flag_R"], "line": ["line_O", "line_F"],
}


def _r2_sql(c: str) -> str:
    return f"""SELECT '{c}' AS covariate, (sxy - sx * sy / n) * (sxy - sx * sy / n) / ((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r2
  FROM (SELECT sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy
  FROM (SELECT {c} - (SELECT avg({c}) FROM cov) AS x, outcome - (SELECT avg(outcome) FROM cov) AS y, hh_wgt AS w FROM cov))"""


@query(with_(COV) + f"SELECT covariate, round(r2, 6) AS r2 FROM ({' UNION ALL '.join(_r2_sql(c) for c in NUMBERS)})")
def univariate_r2(spark, sf):
    return rounded(R.univariate_r2(covariates(spark, sf), NUMBERS, "outcome", "hh_wgt"), "r2")


@query(with_(COV) + """, m AS (SELECT sum(hh_wgt) AS n, sum(hh_wgt * l_extendedprice) / sum(hh_wgt) AS m1, sum(hh_wgt * l_discount) / sum(hh_wgt) AS m2,
  sum(hh_wgt * outcome) / sum(hh_wgt) AS my FROM cov),
s AS (SELECT max(n) AS n, max(m1) AS m1, max(m2) AS m2, max(my) AS my,
  sum(hh_wgt * (l_extendedprice - m1) * (l_extendedprice - m1)) AS s11, sum(hh_wgt * (l_discount - m2) * (l_discount - m2)) AS s22,
  sum(hh_wgt * (l_extendedprice - m1) * (l_discount - m2)) AS s12, sum(hh_wgt * (l_extendedprice - m1) * (outcome - my)) AS s1y,
  sum(hh_wgt * (l_discount - m2) * (outcome - my)) AS s2y, sum(hh_wgt * (outcome - my) * (outcome - my)) AS syy FROM cov, m),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT round(my - b1 * m1 - b2 * m2, 5) AS intercept, round(b1, 8) AS b_price, round(b2, 5) AS b_discount,
  round((syy - b1 * s1y - b2 * s2y) / n, 5) AS mse, round((b1 * s1y + b2 * s2y) / syy, 6) AS r2 FROM b""")
def weighted_least_squares(spark, sf):
    fit = R.weighted_least_squares(covariates(spark, sf), ["l_extendedprice", "l_discount"], "outcome", "hh_wgt")
    row = (fit.intercept, *fit.coefficients, fit.mse, fit.r2)
    out = spark.createDataFrame([row], "intercept double, b_price double, b_discount double, mse double, r2 double")
    out = rounded(rounded(out, "intercept", "b_discount", "mse", digits=5), "b_price", digits=8)
    return rounded(out, "r2")


@query(with_(COV) + """, w AS (SELECT fold, sum(hh_wgt) AS n, sum(hh_wgt * l_extendedprice) AS sx, sum(hh_wgt * outcome) AS sy,
  sum(hh_wgt * l_extendedprice * l_extendedprice) AS sxx, sum(hh_wgt * l_extendedprice * outcome) AS sxy FROM cov GROUP BY fold),
t AS (SELECT a.fold, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM w a JOIN w b ON a.fold <> b.fold GROUP BY a.fold),
f AS (SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS a FROM t),
e AS (SELECT f.fold, cov.fold = f.fold AS is_test, 1 - sum((outcome - a - b * l_extendedprice) * (outcome - a - b * l_extendedprice)) / (var_pop(outcome) * count(*)) AS r2
  FROM cov, f GROUP BY ALL)
SELECT round(avg(r2) FILTER (NOT is_test), 6) AS train_r2, round(avg(r2) FILTER (is_test), 6) AS test_r2 FROM e""")
def cross_validated_regression(spark, sf):
    r = R.cross_validated_r2(covariates(spark, sf), ["l_extendedprice"], "outcome", "fold", "hh_wgt")
    out = spark.createDataFrame([(r["train_r2"], r["test_r2"])], "train_r2 double, test_r2 double")
    return rounded(out, "train_r2", "test_r2")


@query()
def forward_selection(spark, sf):
    return R.forward_selection(covariates(spark, sf), CANDIDATES, "outcome", "hh_wgt", "fold")


@query()
def forward_selection_by_group(spark, sf):
    return R.forward_selection_by_group(
        covariates(spark, sf), "l_returnflag",
        {k: v for k, v in CANDIDATES.items() if k != "flag"}, "outcome", "hh_wgt", "fold", steps=3,
    )


def learner_table(spark, sf):
    """Households with an outcome that depends on size, assets and area."""
    hh = households(spark, sf)
    outcome = (
        F.col("consumption") / 8 + F.col("hh_size") * 0.3 + F.col("assets") / 5000
        + F.when(F.col("area") == "1-URGENT", 1.0).otherwise(0.0)
    )
    return hh.withColumns(
        {
            "outcome": outcome,
            "urgent": F.when(F.col("area") == "1-URGENT", 1.0).otherwise(0.0),
            "closed": F.when(F.col("status") == "F", 1.0).otherwise(0.0),
        }
    )


def with_folds(spark, sf):
    return S.even_folds(learner_table(spark, sf), "hhid", 3, 5)


LEARN = ["hh_size", "assets", "urgent", "closed", "hh_wgt"]


@query()
def lasso_cv(spark, sf):
    r = R.lasso_cv(with_folds(spark, sf), LEARN, "outcome", "fold", [3e-4, 1e-2, 3e-1], "weight")
    rows = [(r["alpha"], r["r2"], c, b) for c, b in r["coefficients"].items()]
    return spark.createDataFrame(rows, "alpha double, r2 double, covariate string, coefficient double")


@query()
def gbt_cv(spark, sf):
    r = R.boosted_trees_cv(
        with_folds(spark, sf), LEARN, "outcome", "fold", 3, depths=(1, 3), leaf_sizes=(7,), weight="weight", trees=8
    )
    return spark.createDataFrame([(r["max_depth"], r["min_leaf"], r["r2"])], "max_depth int, min_leaf int, r2 double")


@query()
def pca_regression(spark, sf):
    r = R.component_regression_cv(with_folds(spark, sf), LEARN, 3, "outcome", "fold", "weight", scale=True)
    return spark.createDataFrame([(3, r["train_r2"], r["test_r2"])], "n_pca int, train_r2 double, test_r2 double")


@query()
def logit_cv(spark, sf):
    data = with_folds(spark, sf).withColumn("poor", (F.col("outcome") < 2.15).cast("double"))
    r = R.logistic_cv(data, ["hh_size", "assets", "urgent"], "poor", "fold", 3, strengths=(1e-2, 1.0, 100.0))
    return spark.createDataFrame([(r["C"], r["r2"])], "c double, r2 double")


# ---------------------------------------------------------------- fits on few columns, which SQL can repeat


def _sums(keys: str) -> str:
    return f"""SELECT {keys}, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM long GROUP BY {keys}"""


def _score(s: str) -> str:
    return f"({s}.syy - 2 * a * {s}.sy - 2 * b * {s}.sxy + {s}.n * a * a + 2 * a * b * {s}.sx + b * b * {s}.sxx)"


def _first_step(columns: list[str], group: str) -> str:
    """The first step of forward selection over single columns: the best weighted R2 out of the fold."""
    centre = f"(SELECT l_returnflag, {', '.join(f'avg({c}) AS m_{c}' for c in columns)}, avg(outcome) AS my FROM cov GROUP BY l_returnflag)"
    if group == "'all'":
        centre = f"(SELECT {', '.join(f'avg({c}) AS m_{c}' for c in columns)}, avg(outcome) AS my FROM cov)"
        joined = f"cov, {centre} m"
    else:
        joined = f"cov JOIN {centre} m USING (l_returnflag)"
    parts = " UNION ALL ".join(
        f"SELECT {group} AS g, '{c}' AS c, fold, {c} - m_{c} AS x, outcome - my AS y, hh_wgt AS w FROM {joined}" for c in columns
    )
    return with_(COV) + f""", long AS ({parts}), s AS ({_sums('g, c, fold')}), whole AS ({_sums('g, c')}),
t AS (SELECT s.g, s.c, s.fold, whole.n - s.n AS n, whole.sx - s.sx AS sx, whole.sy - s.sy AS sy, whole.sxx - s.sxx AS sxx, whole.sxy - s.sxy AS sxy, whole.syy - s.syy AS syy FROM s JOIN whole ON s.g = whole.g AND s.c = whole.c),
f AS (SELECT *, (sy - b * sx) / n AS a FROM (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b FROM t)),
e AS (SELECT f.g, f.c, avg({_score('f')} / f.n) AS is_mse, avg({_score('s')} / s.n) AS oos_mse,
  avg(1 - {_score('f')} / (f.syy - f.sy * f.sy / f.n)) AS is_r2, avg(1 - {_score('s')} / (s.syy - s.sy * s.sy / s.n)) AS oos_r2
  FROM f JOIN s ON f.g = s.g AND f.c = s.c AND f.fold = s.fold GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY oos_r2 DESC, c) AS place FROM e),
size AS (SELECT {group} AS g, count(*) AS rows FROM cov GROUP BY 1)
SELECT best.g AS "group", best.c AS covariate, round(is_mse, 3) AS is_mse, round(oos_mse, 3) AS oos_mse, round(is_r2, 3) AS is_r2, round(oos_r2, 3) AS oos_r2,
  round((sxy - sx * sy / n) * (sxy - sx * sy / n) / ((sxx - sx * sx / n) * (syy - sy * sy / n)), 3) AS single_covariate_r2, rows, rows AS complete
FROM best JOIN whole ON best.g = whole.g AND best.c = whole.c JOIN size ON best.g = size.g WHERE place = 1"""


SELECTED = ["covariate", "is_mse", "oos_mse", "is_r2", "oos_r2", "single_covariate_r2", "rows", "complete"]


@query(_first_step(NUMBERS, "'all'"))
def forward_first_step(spark, sf):
    """The first covariate that forward selection takes."""
    found = R.forward_selection(covariates(spark, sf), {c: [c] for c in NUMBERS}, "outcome", "hh_wgt", "fold", steps=1)
    return found.select(F.lit("all").alias("group"), *SELECTED)


@query(_first_step(["l_discount", "l_quantity", "l_tax"], "l_returnflag"))
def forward_first_step_by_group(spark, sf):
    """The first covariate in every group."""
    names = {c: [c] for c in ("l_discount", "l_quantity", "l_tax")}
    found = R.forward_selection_by_group(covariates(spark, sf), "l_returnflag", names, "outcome", "hh_wgt", "fold", steps=1)
    return found.select(F.col("l_returnflag").alias("group"), *SELECTED)


@query(_first_step(["l_quantity", "l_tax"], "'all'"))
def selection_from_candidate_set(spark, sf):
    """Candidates come from the metadata: by module and by name, without what is dropped, excluded or overridden."""
    described = [
        ("amount", "numeric", "order", ["l_quantity"]), ("price", "numeric", "order", ["l_extendedprice"]),
        ("discount", "numeric", "terms", ["l_discount"]), ("tax", "numeric", "terms", ["l_tax"]),
        ("size", "dropped", "order", ["p_size"]), ("flag", "categorical", "state", ["flag_A", "flag_N", "flag_R"]),
    ]
    meta = spark.createDataFrame(described, "covariate string, type string, module string, columns array<string>")
    rules = {"verifiable": E.CandidateRule(modules=["order"], include=["tax"], exclude=["price"])}
    sets = E.candidate_sets(meta, rules, excluded=["flag"], complement="other")
    found = R.forward_selection(covariates(spark, sf), sets["verifiable"], "outcome", "hh_wgt", "fold", steps=1)
    names = F.create_map(*[F.lit(x) for c, columns in sets["verifiable"].items() for x in (c, columns[0])])
    return found.select(F.lit("all").alias("group"), names[F.col("covariate")].alias("covariate"), *SELECTED[1:])


ALPHAS = [5.0, 2e4, 1e9]


@query(with_(COV) + f""", a AS (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha), long AS (SELECT fold, l_extendedprice AS x, outcome AS y, hh_wgt AS w FROM cov),
s AS ({_sums('fold')}), k AS (SELECT -1 AS f UNION ALL SELECT fold FROM s),
t AS (SELECT f, sum(n) AS n, sum(sx) / sum(n) AS mx, sum(sy) / sum(n) AS my, sum(sxx) / sum(n) - (sum(sx) / sum(n)) * (sum(sx) / sum(n)) AS vxx,
  sum(sxy) / sum(n) - (sum(sx) / sum(n)) * (sum(sy) / sum(n)) AS vxy FROM k JOIN s ON fold <> f GROUP BY f),
b AS (SELECT f, alpha, my, mx, sign(vxy) * greatest(abs(vxy) - alpha, 0) / vxx AS b FROM t, a),
r AS (SELECT alpha, f, 1 - sum((outcome - my - b * (l_extendedprice - mx)) * (outcome - my - b * (l_extendedprice - mx))) / (var_pop(outcome) * count(*)) AS r2 FROM cov JOIN b ON fold = f GROUP BY ALL),
best AS (SELECT alpha, avg(r2) AS r2 FROM r GROUP BY alpha ORDER BY r2 DESC LIMIT 1)
SELECT best.alpha, round(r2, 6) AS r2, round(my - b * mx, 6) AS intercept, round(b, 9) AS coefficient, (SELECT count(*) FROM cov) AS complete FROM best JOIN b ON best.alpha = b.alpha WHERE f = -1""")
def lasso_one_column(spark, sf):
    """The lasso on one column is a soft threshold."""
    r = R.lasso_cv(covariates(spark, sf), ["l_extendedprice"], "outcome", "fold", ALPHAS, "hh_wgt")
    row = (r["alpha"], r["r2"], r["intercept"], r["coefficients"]["l_extendedprice"], r["complete"])
    out = spark.createDataFrame([row], "alpha double, r2 double, intercept double, coefficient double, complete long")
    return rounded(rounded(out, "r2", "intercept"), "coefficient", digits=9)


def _folds_sql(x: str) -> str:
    """Train and test R2 of a weighted fit on one column ``x`` of the table ``data``."""
    return f"""w AS (SELECT fold, sum(hh_wgt) AS n, sum(hh_wgt * {x}) AS sx, sum(hh_wgt * outcome) AS sy, sum(hh_wgt * {x} * {x}) AS sxx, sum(hh_wgt * {x} * outcome) AS sxy FROM data GROUP BY fold),
t AS (SELECT a.fold, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM w a JOIN w b ON a.fold <> b.fold GROUP BY a.fold),
f AS (SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS a FROM t),
e AS (SELECT f.fold, data.fold = f.fold AS is_test, 1 - sum((outcome - a - b * {x}) * (outcome - a - b * {x})) / (var_pop(outcome) * count(*)) AS r2 FROM data, f GROUP BY ALL)"""


@query(with_(COV) + f""", m AS (SELECT avg(l_quantity) AS m1, avg(p_size) AS m2, var_pop(l_quantity) AS s11, var_pop(p_size) AS s22, covar_pop(l_quantity, p_size) AS s12 FROM cov),
angle AS (SELECT *, atan2(2 * s12, s11 - s22) / 2 AS turn FROM m),
data AS (SELECT cov.*, cos(turn) * (l_quantity - m1) + sin(turn) * (p_size - m2) AS pc FROM cov, angle), {_folds_sql('pc')}
SELECT round(avg(r2) FILTER (NOT is_test), 6) AS train_r2, round(avg(r2) FILTER (is_test), 6) AS test_r2 FROM e""")
def first_component_regression(spark, sf):
    """The first component of two columns is an angle."""
    r = R.component_regression_cv(covariates(spark, sf), ["l_quantity", "p_size"], 1, "outcome", "fold", "hh_wgt")
    out = spark.createDataFrame([(r["train_r2"], r["test_r2"])], "train_r2 double, test_r2 double")
    return rounded(out, "train_r2", "test_r2")


@query(with_(COV) + """, z AS (SELECT fold, (l_extendedprice > 50000)::INT AS x, (l_quantity > 25)::INT AS y FROM cov),
p AS (SELECT k.fold, x, avg(y) > 0.5 AS hit FROM z, (SELECT DISTINCT fold FROM z) k WHERE z.fold <> k.fold GROUP BY ALL),
e AS (SELECT z.fold, 1 - sum((y - hit::INT) * (y - hit::INT)) / (var_pop(y) * count(*)) AS r2 FROM z JOIN p ON z.fold = p.fold AND z.x = p.x GROUP BY z.fold)
SELECT round(avg(r2), 6) AS r2, (SELECT count(*) FROM cov) AS complete FROM e""")
def logit_one_indicator(spark, sf):
    """With one indicator and hardly a penalty the predicted class is the majority of the group."""
    data = covariates(spark, sf).withColumn("dear", (F.col("l_extendedprice") > 50000).cast("double"))
    data = data.withColumn("many", (F.col("l_quantity") > 25).cast("double"))
    r = R.logistic_cv(data, ["dear"], "many", "fold", 7, strengths=(1e6,))
    return rounded(spark.createDataFrame([(r["r2"], r["complete"])], "r2 double, complete long"), "r2")


@query(with_(COV) + """, z AS (SELECT fold, hh_wgt, (l_extendedprice > 50000)::INT AS x, outcome AS y FROM cov),
p AS (SELECT k.fold, x, sum(hh_wgt * y) / sum(hh_wgt) AS m FROM z, (SELECT DISTINCT fold FROM z) k WHERE z.fold <> k.fold GROUP BY ALL),
e AS (SELECT z.fold, 1 - sum((y - m) * (y - m)) / (var_pop(y) * count(*)) AS r2 FROM z JOIN p ON z.fold = p.fold AND z.x = p.x GROUP BY z.fold)
SELECT 1 AS max_depth, round(avg(r2), 6) AS r2 FROM e""")
def one_tree_on_an_indicator(spark, sf):
    """One tree of depth one on an indicator predicts the groups' means."""
    data = covariates(spark, sf).withColumn("dear", (F.col("l_extendedprice") > 50000).cast("double"))
    r = R.boosted_trees_cv(data, ["dear"], "outcome", "fold", 7, depths=(1,), leaf_sizes=(1,), weight="hh_wgt", trees=1)
    return rounded(spark.createDataFrame([(r["max_depth"], r["r2"])], "max_depth int, r2 double"), "r2")


def _fold_order(seed: int, folds: int) -> str:
    """Folds of the random order that both engines have."""
    steps = ", ".join(str(i) for i in range(1, folds))
    return f"list_sum([(r > round_even(i * n / {folds}.0, 0))::INT FOR i IN [{steps}]])::INT"


def _learner_sql(seed: int, folds: int) -> str:
    return f"""learner AS (SELECT *, consumption / 8 + hh_size * 0.3 + assets / 5000 + CASE WHEN area = '1-URGENT' THEN 1.0 ELSE 0.0 END AS outcome,
  row_number() OVER (ORDER BY substr(md5('{seed}:' || hhid::VARCHAR), 1, 15), hhid::VARCHAR) AS r, count(*) OVER () AS n FROM hh),
folded AS (SELECT *, {_fold_order(seed, folds)} AS fold FROM learner)"""


def _grid_cell(name: str, x: str, y: str) -> str:
    body = _folds_sql("x").replace("hh_wgt", "weight")
    return f"""SELECT '{name}' AS columns, '{y}' AS outcome, round(avg(r2) FILTER (is_test), 6) AS lr_oos, round(avg(r2) FILTER (NOT is_test), 6) AS lr_is
FROM (WITH data AS (SELECT fold, weight, {x} AS x, {y} AS outcome FROM folded), {body} SELECT * FROM e)"""


@query(with_(HH, _learner_sql(0, 3)) + f"""SELECT *, (SELECT count(*) FROM hh) AS rows, (SELECT count(*) FROM hh) AS complete FROM (
{_grid_cell('assets', 'assets', 'outcome')} UNION ALL {_grid_cell('size', 'hh_size', 'outcome')} UNION ALL {_grid_cell('size', 'hh_size', 'consumption')}
UNION ALL {_grid_cell('component', 'assets', 'consumption')})""")
def model_grid_of_single_columns(spark, sf):
    """A grid whose cells are regressions on one column; the one component of a column is the column."""
    specs = [
        M.ModelSpec("assets", ["assets"], "outcome"), M.ModelSpec("size", ["hh_size"], "outcome"),
        M.ModelSpec("size", ["hh_size"], "consumption"), M.ModelSpec("component", ["assets"], "consumption", components=1),
    ]
    grid = M.model_grid(learner_table(spark, sf), specs, "hhid", "weight", folds=3)
    return rounded(grid.select("columns", "outcome", "lr_oos", "lr_is", "rows", "complete"), "lr_oos", "lr_is")


def area_sql(alpha: float, places: list[str]) -> str:
    """The penalised effect of every district: the intercept solves an equation that is linear between breakpoints."""
    first = ", ".join(f"arg_min({c}, hhid) AS {c}" for c in places)
    return with_(HH, _learner_sql(0, 5)) + f""", m AS (SELECT district, sum(weight) AS w, sum(weight * outcome) / sum(weight) AS m, {first} FROM folded GROUP BY district),
t AS (SELECT sum(w) * {alpha}::DOUBLE AS p FROM m), breaks AS (SELECT m - p / w AS pos FROM m, t UNION SELECT m + p / w FROM m, t),
g AS (SELECT pos, sum(greatest(least(w * (m - pos), p), -p)) AS g, max(p) AS p FROM breaks, m, t GROUP BY pos),
z AS (SELECT max(pos) FILTER (g > p * 1e-9) AS a, min(pos) FILTER (g < -p * 1e-9) AS b, min(pos) FILTER (abs(g) <= p * 1e-9) AS lo, max(pos) FILTER (abs(g) <= p * 1e-9) AS hi FROM g),
c AS (SELECT CASE WHEN lo IS NOT NULL THEN (lo + hi) / 2 ELSE a + (SELECT g FROM g WHERE pos = a) * (b - a) / ((SELECT g FROM g WHERE pos = a) - (SELECT g FROM g WHERE pos = b)) END AS c FROM z)
SELECT district AS id, round(sign(m - c) * greatest(abs(m - c) - p / w, 0), 6) AS coefficient, {', '.join(places)} FROM m, t, c"""


@query(area_sql(2e-3, ["assets"]))
def area_effects_of_districts(spark, sf):
    """The penalised effect of every district beside the assets of its first household."""
    out = M.area_effects(learner_table(spark, sf), "district", ["assets"], "outcome", "hhid", "weight", [2e-3])
    return rounded(out, "coefficient")


@query(with_(COV) + f"""SELECT covariate, round(r2, 6) AS r2, r2 > 0.9 AS leak FROM ({_r2_sql('l_extendedprice')} UNION ALL {_r2_sql('l_quantity')})""")
def leakage_check(spark, sf):
    """A covariate that holds the outcome is refused."""
    data, rows = covariates(spark, sf), []
    for c in ("l_extendedprice", "l_quantity"):
        try:
            rows.append((c, R.check_leakage(data, [c], "outcome", "hh_wgt"), False))
        except ValueError:
            rows.append((c, R.weighted_least_squares(data, [c], "outcome", "hh_wgt").r2, True))
    return rounded(spark.createDataFrame(rows, "covariate string, r2 double, leak boolean"), "r2")


PMT_BUDGETS = [0.1, 0.4, 0.9, 1.6]
_NOW = "consumption + CASE WHEN p <= top THEN 1.5 ELSE 0 END"


@query(with_(HH, _learner_sql(5, 3)) + f""", data AS (SELECT fold, weight AS hh_wgt, assets AS x, consumption AS outcome FROM folded),
{_folds_sql('x')}, scored AS (SELECT folded.*, round(a + b * assets, 9) AS p FROM folded JOIN f ON folded.fold = f.fold),
v AS (SELECT p, sum(weight) AS w FROM scored GROUP BY p), c AS (SELECT p, sum(w) OVER (ORDER BY p) * 1.5 / (SELECT sum(weight) FROM hh) AS cost FROM v),
q AS (SELECT budget, max(p) FILTER (cost <= budget) AS top FROM c, (SELECT unnest({PMT_BUDGETS}::DOUBLE[]) AS budget) GROUP BY budget)
SELECT budget, round(sum(greatest({LINE} - ({_NOW}), 0) * weight) / sum(weight), 6) AS post_transfer_poverty_gap,
  round(sum(CASE WHEN {_NOW} < {LINE} THEN weight ELSE 0 END) / sum(weight), 6) AS post_transfer_poverty_rate,
  round(sum(CASE WHEN p <= top THEN 1.5 * weight ELSE 0 END) / sum(weight), 6) AS policy_cost_per_capita FROM scored, q GROUP BY budget""")
def proxy_means_test(spark, sf):
    """Transfers in the order of consumption predicted by a fit that has not seen the household."""
    folded = S.even_folds(learner_table(spark, sf), "hhid", 3, 5)
    scored = R.out_of_fold(folded, ["assets"], "consumption", "fold", [0.0], "weight")
    scored = scored.withColumn("predicted", F.round("predicted", 9))
    out = P.ranked_transfer(scored, "consumption", "weight", "predicted", LINE, 1.5, PMT_BUDGETS)
    names = ["post_transfer_poverty_gap", "post_transfer_poverty_rate", "policy_cost_per_capita"]
    return rounded(out.select("budget", *names), *names)

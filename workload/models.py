"""Model selection, scoring, attribution, scenarios and presentation tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arealis.functions import colour
from arealis.functions import geometry as g
from arealis.operators import gridjoin
from arealis.operators import tables as tb
from arealis.plans import attribution, estimators, features, forest, presentation, scoring, training
from arealis.plans.features import FEATURE_COLUMNS
from arealis.session import scratch_path
from arealis.sources import writers
from workload import layers as ly
from workload.registry import query

X = ly.MODEL_FEATURES

# The model queries fit every line of the table, up to millions of rows where the trained
# product has some thousand areas. At the product's own settings (200 unlimited trees, 200
# rounds, 30 draws of 5 folds) one query would take hours here, so these fits are SMALLER
# THAN THE PRODUCT'S: what they check is that fitting, choosing and explaining work, and
# their SQL states what is certain whatever the trees look like. Folds, the Ridge search
# and its grid are full size, and so is all of ``train_level`` and ``compare_levels``.
# ``training`` itself defaults to the full settings.
SMALL = {
    training.FOREST: {"n_estimators": 10, "max_depth": 5},
    training.BOOSTED_LEVEL: {"n_estimators": 8, "max_depth": 4},
    training.BOOSTED_LEAF: {"n_estimators": 8},
}


def builders():
    return training.build_models(X, "y")


def training_rows(spark, sf):
    """The model table, kept: fitting reads it many times."""
    return ly.model_table(spark, sf).persist()


def fitted(rows, name) -> PipelineModel:
    return builders()[name](SMALL.get(name, {})).fit(rows)


# --- rows, splits, folds -----------------------------------------------------


@query(
    "model_rows",
    ly.cte(ly.SCORED)
    + """SELECT s.code, name, impervious_ratio, predicted_mean_uhi_2018 AS y, c_nationkey AS grp
FROM scored s LEFT JOIN customer ON code = CAST(c_custkey AS VARCHAR) WHERE predicted_mean_uhi_2018 IS NOT NULL""",
)
def model_rows(spark, sf):
    matrix = ly.scored_areas(spark, sf).select(
        "code", "name", "impervious_ratio", F.col("predicted_mean_uhi_2018").alias("y")
    )
    bounds = ly.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("code"), F.col("c_nationkey").alias("grp")
    )
    return training.model_rows(matrix, bounds.unionByName(bounds), "code", "grp", "y")


@query(
    "group_split",
    """WITH sizes AS (SELECT l_suppkey AS grp, count(*) AS n FROM lineitem GROUP BY l_suppkey),
drawn AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(grp AS VARCHAR) || ':42'), grp) AS rn, count(*) OVER () AS total FROM sizes)
SELECT grp, n, CASE WHEN rn <= ceil(CAST('0.2' AS DOUBLE) * total) THEN 'test' ELSE 'train' END AS side FROM drawn""",
)
def group_split(spark, sf):
    lines = ly.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"))
    train, test = training.group_split(lines, "grp")
    sides = [df.withColumn("side", F.lit(n)) for n, df in (("train", train), ("test", test))]
    return tb.union_tiles(sides).groupBy("grp", "side").agg(F.count(F.lit(1)).alias("n"))


def _folds_sql(table: str, group: str, k: int) -> str:
    """Greedy folds as a recursive statement: largest group first into the lightest fold."""
    return f"""sizes AS (SELECT {group} AS grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {group}) AS rn
  FROM {table} GROUP BY {group}),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS grp, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS fold,
         [{", ".join(["CAST(0 AS BIGINT)"] * k)}] AS loads
  UNION ALL
  SELECT s.rn, s.grp, s.n, list_position(w.loads, list_min(w.loads)) - 1,
         [CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN w.loads[i] + s.n ELSE w.loads[i] END for i in range(1, {k + 1})]
  FROM walk w JOIN sizes s ON s.rn = w.rn + 1),
folds AS (SELECT grp, n, CAST(fold AS INTEGER) AS fold FROM walk WHERE rn > 0)"""


@query(
    "group_folds",
    ly.cte(_folds_sql("lineitem", "l_suppkey", 5)) + "SELECT grp, n, fold FROM folds",
)
def group_folds(spark, sf):
    lines = ly.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"))
    return training.group_folds(lines, "grp", 5).groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "group_folds_with_missing",
    ly.cte(_folds_sql("rows", "grp", 5).replace("ORDER BY count(*) DESC, grp)", "ORDER BY count(*) DESC, grp NULLS FIRST)").replace(
        "sizes AS (", "rows AS (SELECT nullif(l_suppkey % 7, 3) AS grp FROM lineitem),\nsizes AS (", 1
    ))
    + "SELECT grp, n, fold FROM folds",
)
def group_folds_with_missing(spark, sf):
    """Rows without a group are kept, as one group."""
    code = F.col("l_suppkey") % 7
    lines = ly.table(spark, sf, "lineitem").select(F.when(code != 3, code).alias("grp"))
    return training.group_folds(lines, "grp", 5).groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("n"))


# --- estimators --------------------------------------------------------------


@query(
    "median_imputer",
    ly.cte(ly.MODEL)
    + "SELECT row_id, coalesce(x_tax, (SELECT quantile_cont(x_tax, 0.5) FROM model)) AS x_tax, x_price FROM model",
)
def median_imputer(spark, sf):
    model = training_rows(spark, sf)
    filled = estimators.MedianImputer(["x_tax", "x_price"]).fit(model).transform(model)
    return filled.select(
        "row_id", F.col("x_tax__filled").alias("x_tax"), F.col("x_price__filled").alias("x_price")
    )


@query(
    "standardiser",
    ly.cte(ly.MODEL)
    + """SELECT row_id, round((x_quantity - avg(x_quantity) OVER ()) / stddev_pop(x_quantity) OVER (), 6) AS x_quantity,
  round((x_price - avg(x_price) OVER ()) / stddev_pop(x_price) OVER (), 6) AS x_price FROM model""",
)
def standardiser(spark, sf):
    model = training_rows(spark, sf)
    cols = ["x_quantity", "x_price"]
    scaled = Pipeline(stages=[estimators.MedianImputer(cols), estimators.Standardiser(cols)]).fit(model)
    return scaled.transform(model).select(
        "row_id", *(F.round(c + estimators.SCALED, 6).alias(c) for c in cols)
    )


@query(
    "mean_baseline",
    ly.cte(ly.MODEL) + "SELECT round(avg(y), 9) AS prediction, count(*) AS n FROM model",
)
def mean_baseline(spark, sf):
    rows = training_rows(spark, sf)
    scored = fitted(rows, training.BASELINE).transform(rows)
    return scored.groupBy(F.round("prediction", 9).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


_RIDGE_SQL = ly.cte(ly.MODEL) + """, z AS (SELECT row_id, y, avg(y) OVER () AS mean, count(*) OVER () AS n,
  (x_quantity - avg(x_quantity) OVER ()) / stddev_pop(x_quantity) OVER () AS z FROM model),
coef AS (SELECT sum(z * (y - mean)) / (max(n) + 1e1) AS b FROM z)
SELECT row_id, round(mean + b * z, 6) AS prediction FROM z, coef"""


def _one_feature_ridge(rows):
    """With one feature the penalised slope has a closed form."""
    build = training.build_models(["x_quantity"], "y")[training.RIDGE]
    return build({"alpha": 10.0}).fit(rows)


def _predictions(model, rows):
    scored = model.transform(rows)
    return scored.select("row_id", F.round("prediction", 6).alias("prediction"))


@query("ridge", _RIDGE_SQL)
def ridge(spark, sf):
    rows = training_rows(spark, sf)
    return _predictions(_one_feature_ridge(rows), rows)


@query("save_model", _RIDGE_SQL)
def save_model(spark, sf):
    rows = training_rows(spark, sf)
    path = writers.save_model(_one_feature_ridge(rows), scratch_path(spark, "model"))
    return _predictions(writers.load_model(path), rows)


# What is certain of any model that has learned the rule: it saw every line, and its error
# lies below that of the mean, which is the target's deviation.
_BETTER_SQL = ly.cte(ly.MODEL) + """SELECT count(*) AS rows, round(stddev_pop(y), 6) AS error_of_mean,
  true AS below_mean, true AS explains_half FROM model"""


def _fit_quality(spark, sf, name):
    """A fit smaller than the product's (see SMALL), measured on its own rows."""
    rows = training_rows(spark, sf)
    found = training.regression_metrics(fitted(rows, name).transform(rows), "y", "prediction")
    mean = rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.stddev_pop("y"), 6).alias("error_of_mean"))
    return mean.join(found.select((F.col("R2") > 0).alias("below_mean"), (F.col("R2") > 0.5).alias("explains_half")))


@query("random_forest", _BETTER_SQL)
def random_forest(spark, sf):
    return _fit_quality(spark, sf, training.FOREST)


#: Features of so few values that each has a bin of its own.
EXACT = ["x_quantity", "x_discount", "x_tax"]

# A tree without limit that sees every row parts all rows that can be parted: each is
# given the mean of the rows that equal it.
_UNLIMITED_SQL = ly.cte(ly.MODEL) + """, filled AS (SELECT x_quantity, x_discount, coalesce(x_tax, (SELECT quantile_cont(x_tax, 0.5) FROM model)) AS x_tax, y FROM model)
SELECT x_quantity, x_discount, x_tax, count(*) AS rows, round(avg(y) + 1.37e-7, 6) AS prediction FROM filled GROUP BY ALL"""


@query("unlimited_tree", _UNLIMITED_SQL)
def unlimited_tree(spark, sf):
    """Each different row of the features with what a single unlimited tree, grown from all rows, predicts for it."""
    rows = training_rows(spark, sf)
    filled = estimators.MedianImputer(EXACT).fit(rows).transform(rows)
    table = VectorAssembler(inputCols=[c + estimators.FILLED for c in EXACT], outputCol="features").transform(filled)
    model = forest.DeepForest("y", forest.Settings(trees=1, bootstrap=False)).fit(table)
    same = table.groupBy(*[F.col(c + estimators.FILLED).alias(c) for c in EXACT], "features").agg(F.count(F.lit(1)).alias("rows"))
    # targets are multiples of 1/1024: the small shift keeps means off the borders of rounding
    return model.transform(same).select(*EXACT, "rows", F.round(F.col("prediction") + 1.37e-7, 6).alias("prediction"))


def _best_split_sql(rows: str, l2: str, least: int) -> str:
    """The split of most gain of ``rows`` (q, d, t, y and prediction p), by the sums of all values below each cut."""
    values = " UNION ALL ".join(f"SELECT {i} AS f, {c} AS v, y - p AS r FROM {rows}" for i, c in enumerate("qdt"))
    return f"""SELECT f, cut, gl, nl, g, n, (gl * gl / (nl + {l2}) + (g - gl) * (g - gl) / (n - nl + {l2}) - g * g / (n + {l2})) / 2 AS gain FROM (
  SELECT f, v / 2 + lead(v) OVER w / 2 AS cut, sum(r) OVER w AS gl, sum(c) OVER w AS nl, sum(r) OVER (PARTITION BY f) AS g, sum(c) OVER (PARTITION BY f) AS n
  FROM (SELECT f, v, sum(r) AS r, count(*) AS c FROM ({values}) GROUP BY f, v) WINDOW w AS (PARTITION BY f ORDER BY v))
  WHERE cut IS NOT NULL AND nl >= {least} AND n - nl >= {least} ORDER BY gain DESC, f, cut LIMIT 1"""


_NAMES = "['x_quantity', 'x_discount', 'x_tax'][CAST(f AS INTEGER) + 1]"


def _boosted_sql(l2: str, least: int, extra: str) -> str:
    return ly.cte(ly.MODEL) + f"""sides AS (SELECT grp, row_number() OVER (ORDER BY md5(CAST(grp AS VARCHAR) || ':42'), grp) <= ceil(CAST('0.2' AS DOUBLE) * count(*) OVER ()) AS held
  FROM (SELECT DISTINCT grp FROM model)),
own AS (SELECT m.* FROM model m JOIN sides USING (grp) WHERE NOT held),
train AS MATERIALIZED (SELECT x_quantity AS q, x_discount AS d, coalesce(x_tax, (SELECT quantile_cont(x_tax, 0.5) FROM own)) AS t, y, avg(y) OVER () AS p FROM own),
best AS ({_best_split_sql("train", l2, least)})
SELECT {_NAMES} AS feature, cut AS threshold, round(gain / n, 6) AS gain_of_a_row, CAST(n AS BIGINT) AS rows, CAST(nl AS BIGINT) AS left_rows,
  round(gl / (nl + {l2}), 6) AS left_value, round((g - gl) / (n - nl + {l2}), 6) AS right_value,
  (SELECT count(*) FROM model JOIN sides USING (grp) WHERE held) AS held_out, {extra}, true AS explains_most FROM best""".replace("sides AS (", ", sides AS (", 1)


def _splits(model, spark):
    """The root of each boosted tree beside its children's values; tree 0 is the start value."""
    nodes = attribution.tree_table(model, spark)
    child = lambda side: nodes.select("treeID", F.col("id").alias(f"{side}Child"), F.col("prediction").alias(f"{side}_value"), F.col("cover").alias(f"{side}_rows"))
    return nodes.where("id = 0 AND treeID > 0").join(child("left"), ["treeID", "leftChild"]).join(child("right"), ["treeID", "rightChild"])


def _first_split(spark, sf, name):
    """The first split of the first tree, in full, and what the model explains of groups it hasn't seen.

    The trees are fewer than the product's (see SMALL).
    """
    train, test = training.group_split(training_rows(spark, sf), "grp")
    model = training.build_models(EXACT, "y")[name](SMALL[name]).fit(train)
    held = training.regression_metrics(model.transform(test), "y", "prediction").select((F.col("R2") > 0.5).alias("explains_most"))
    split = _splits(model, spark).where("treeID = 1").select(
        F.element_at(F.array(*map(F.lit, EXACT)), F.col("feature") + 1).alias("feature"),
        "threshold",
        F.round("gain", 6).alias("gain_of_a_row"),
        F.col("cover").cast("long").alias("rows"),
        F.col("left_rows").cast("long").alias("left_rows"),
        *(F.round(f"{s}_value", 6).alias(f"{s}_value") for s in ("left", "right")),
    )
    leaves = attribution.tree_table(model, spark).where("treeID = 1").agg(
        F.sum((F.col("leftChild") < 0).cast("long")).alias("leaves")
    )
    many = test.agg(F.count(F.lit(1)).alias("held_out"))
    return split.join(leaves).join(many).join(held)


@query("boosted_trees_level", _boosted_sql("1e0", 1, "CAST(16 AS BIGINT) AS leaves"))
def boosted_trees_level(spark, sf):
    return _first_split(spark, sf, training.BOOSTED_LEVEL)


@query("boosted_trees_leaf", _boosted_sql("0e0", 20, "CAST(31 AS BIGINT) AS leaves"))
def boosted_trees_leaf(spark, sf):
    return _first_split(spark, sf, training.BOOSTED_LEAF)


# Three rounds of one split each can be said in SQL to the last digit: every round's
# sums are taken over the predictions after the rounds before.
_STUMPS = {"n_estimators": 3, "max_depth": 1, "learning_rate": 0.5}


def _stumps_sql(rounds: int) -> str:
    out = ["""filled AS (SELECT row_id, x_quantity AS q, x_discount AS d, coalesce(x_tax, (SELECT quantile_cont(x_tax, 0.5) FROM model)) AS t, y FROM model),
p0 AS MATERIALIZED (SELECT *, avg(y) OVER () AS p FROM filled)"""]
    for k in range(1, rounds + 1):
        out.append(f"s{k} AS MATERIALIZED ({_best_split_sql(f'p{k - 1}', '1e0', 1)})")
        out.append(f"""p{k} AS MATERIALIZED (SELECT row_id, q, d, t, y,
  p + CAST('0.5' AS DOUBLE) * CASE WHEN [q, d, t][CAST(f AS INTEGER) + 1] <= cut THEN gl / (nl + 1e0) ELSE (g - gl) / (n - nl + 1e0) END AS p FROM p{k - 1}, s{k})""")
    out.append("s AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM s{k}" for k in range(1, rounds + 1)) + ")")
    return ly.cte(ly.MODEL) + ", " + ",\n".join(out)


def stumps(rows):
    return training.build_models(EXACT, "y")[training.BOOSTED_LEVEL](_STUMPS).fit(rows)


@query(
    "boosted_stumps",
    _stumps_sql(3) + f"""SELECT CAST(k AS INTEGER) AS round, {_NAMES} AS feature, cut AS threshold, round(gain / n, 6) AS gain_of_a_row, CAST(nl AS BIGINT) AS left_rows,
  CAST(n - nl AS BIGINT) AS right_rows, round(gl / (nl + 1e0), 6) AS left_value, round((g - gl) / (n - nl + 1e0), 6) AS right_value FROM s""",
)
def boosted_stumps(spark, sf):
    """Every split of three rounds over all lines."""
    return _splits(stumps(training_rows(spark, sf)), spark).select(
        F.col("treeID").alias("round"),
        F.element_at(F.array(*map(F.lit, EXACT)), F.col("feature") + 1).alias("feature"),
        "threshold",
        F.round("gain", 6).alias("gain_of_a_row"),
        *(F.col(f"{s}_rows").cast("long").alias(f"{s}_rows") for s in ("left", "right")),
        *(F.round(f"{s}_value", 6).alias(f"{s}_value") for s in ("left", "right")),
    )


@query(
    "boosted_importance",
    _stumps_sql(3) + f"""SELECT v.feature, round(coalesce(sum(gain) FILTER ({_NAMES} = v.feature), 0) / sum(gain), 6) AS importance
FROM s, (VALUES ('x_quantity'), ('x_discount'), ('x_tax')) AS v(feature) GROUP BY v.feature""",
)
def boosted_importance(spark, sf):
    """Share of all gain by feature."""
    found = training.feature_importance(stumps(training_rows(spark, sf)), EXACT, spark)
    return found.select("feature", F.round("importance", 6).alias("importance"))


@query(
    "boosted_shap",
    _stumps_sql(3) + f""", leaf AS (SELECT k, {_NAMES} AS feature, f, cut, CAST('0.5' AS DOUBLE) * gl / (nl + 1e0) AS a, CAST('0.5' AS DOUBLE) * (g - gl) / (n - nl + 1e0) AS b, nl, n FROM s),
own AS (SELECT feature, f, cut, a, b, (nl * a + (n - nl) * b) / n AS e FROM leaf),
base AS (SELECT (SELECT avg(y) FROM model) + sum(e) AS base FROM own)
SELECT row_id, v.feature, [q, d, t][v.f + 1] AS value, round(base, 6) AS base_value,
  round(coalesce((SELECT sum(CASE WHEN [q, d, t][v.f + 1] <= cut THEN a ELSE b END - e) FROM own WHERE own.f = v.f), 0), 6) AS shap
FROM filled, base, (VALUES ('x_quantity', 0), ('x_discount', 1), ('x_tax', 2)) AS v(feature, f)""",
)
def boosted_shap(spark, sf):
    """Attribution of every row and feature in closed form: a split's leaf against its mean leaf."""
    rows = training_rows(spark, sf)
    found = attribution.tree_shap(stumps(rows), rows, "row_id", EXACT)
    # no negative zeros
    return found.withColumns({c: F.round(c, 6) + 0.0 for c in ("shap", "base_value")})


# --- comparison and search ---------------------------------------------------

_METRICS = """sqrt(avg(({p} - {y}) * ({p} - {y}))) AS "RMSE", avg(abs({p} - {y})) AS "MAE",
  1 - avg(({p} - {y}) * ({p} - {y})) / var_pop({y}) AS "R2\""""


@query(
    "grouped_cv",
    ly.cte(ly.MODEL, _folds_sql("model", "grp", 5))
    + f""", held AS (SELECT m.y, f.fold, (SELECT avg(m2.y) FROM model m2 JOIN folds f2 USING (grp) WHERE f2.fold <> f.fold) AS p
  FROM model m JOIN folds f USING (grp)),
per_fold AS (SELECT fold, {_METRICS.format(p='p', y='y')} FROM held GROUP BY fold)
SELECT 'Mean baseline' AS model, round(avg("RMSE"), 6) AS "RMSE_mean", round(stddev_pop("RMSE"), 6) AS "RMSE_std",
  round(avg("MAE"), 6) AS "MAE_mean", round(stddev_pop("MAE"), 6) AS "MAE_std",
  round(avg("R2"), 6) AS "R2_mean", round(stddev_pop("R2"), 6) AS "R2_std" FROM per_fold""",
)
def grouped_cv(spark, sf):
    only = {training.BASELINE: builders()[training.BASELINE]}
    found = training.grouped_cv(only, ly.model_table(spark, sf), "grp", "y", features=X)
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c != "model"})


@query(
    "model_comparison",
    ly.cte(ly.MODEL, _folds_sql("model", "grp", 5))
    + f""", held AS (SELECT m.y, f.fold, (SELECT avg(m2.y) FROM model m2 JOIN folds f2 USING (grp) WHERE f2.fold <> f.fold) AS p
  FROM model m JOIN folds f USING (grp)),
per_fold AS (SELECT fold, {_METRICS.format(p='p', y='y')} FROM held GROUP BY fold)
SELECT model, model <> 'Mean baseline' AS beats_mean, round(avg("RMSE"), 6) AS error_of_mean FROM per_fold, (VALUES
  ('Mean baseline'), ('Ridge'), ('Random Forest'), ('Boosted trees (level)'), ('Boosted trees (leaf)')) AS v(model) GROUP BY model""",
)
def model_comparison(spark, sf):
    """All five models over five grouped folds; the trees are smaller than the product's (see SMALL)."""
    found = training.grouped_cv(builders(), ly.model_table(spark, sf), "grp", "y", 5, SMALL, X)
    mean = F.max(F.when(F.col("model") == training.BASELINE, F.col("RMSE_mean"))).over(Window.partitionBy(F.lit(1)))
    return found.withColumn("mean", mean).select(
        "model", (F.col("RMSE_mean") < F.col("mean")).alias("beats_mean"), F.round("mean", 6).alias("error_of_mean")
    )


@query(
    "random_search",
    ly.cte(ly.MODEL, _folds_sql("model", "grp", 5))
    + """, j AS (SELECT m.y, m.x_quantity AS x, f.fold FROM model m JOIN folds f USING (grp)),
t AS (SELECT k.fold, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) * count(*) / stddev_pop(x) AS zy
  FROM j JOIN (SELECT DISTINCT fold FROM folds) k ON j.fold <> k.fold GROUP BY k.fold),
e AS (SELECT alpha, fold, sqrt(avg(power(y - (my + zy / (n + alpha) * (x - mx) / sx), 2))) AS rmse
  FROM j JOIN t USING (fold), (VALUES (0.1e0), (1e0), (3e0), (10e0), (30e0), (100e0)) AS a(alpha) GROUP BY alpha, fold)
SELECT alpha, round(avg(rmse), 6) AS rmse FROM e GROUP BY alpha""",
)
def random_search(spark, sf):
    """Thirty draws ask for more than the six points of the Ridge grid, so all are tried, over five folds."""
    build = training.build_models(["x_quantity"], "y")[training.RIDGE]
    found = training.random_search(build, training.RIDGE_GRID, ly.model_table(spark, sf), "grp", "y", features=["x_quantity"])
    assert found.best_rmse == min(r for _, r in found.tried)
    rows = [(float(p["alpha"]), rmse) for p, rmse in found.tried]
    return spark.createDataFrame(rows, "alpha double, rmse double").withColumn("rmse", F.round("rmse", 6))


@query(
    "regression_metrics",
    ly.cte(ly.MODEL)
    + f"""SELECT round("RMSE", 9) AS "RMSE", round("MAE", 9) AS "MAE", round("R2", 9) AS "R2" FROM (
SELECT {_METRICS.format(p='(2e1 - x_quantity / 8)', y='y')} FROM model)""",
)
def regression_metrics(spark, sf):
    guessed = ly.model_table(spark, sf).withColumn("guess", 20 - F.col("x_quantity") / 8)
    found = training.regression_metrics(guessed, "y", "guess")
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query(
    "feature_importance",
    """SELECT * FROM (VALUES ('x_quantity', true, 1e0), ('x_discount', false, 1e0), ('x_tax', false, 1e0), ('x_price', false, 1e0))
AS v(feature, largest, total)""",
)
def feature_importance(spark, sf):
    """Quantity carries most of the rule; all shares sum to 1. The forest is a small one (see SMALL)."""
    found = training.feature_importance(fitted(training_rows(spark, sf), training.FOREST), X, spark)
    whole = Window.partitionBy(F.lit(1))
    return found.select(
        "feature",
        (F.col("importance") == F.max("importance").over(whole)).alias("largest"),
        F.round(F.sum("importance").over(whole), 9).alias("total"),
    )


def _level(spark, sf, name, group):
    """A whole run over all five models at the product's own settings: 5 folds, 200 trees or rounds, 30 draws of the full grids."""
    return training.train_level(name, ly.model_table(spark, sf).withColumn("by", group), "by", X, "y")


@query(
    "train_level",
    """SELECT 'fine' AS level, count(*) AS n_rows, count(DISTINCT l_suppkey % 25) AS n_groups, true AS beats_mean, true AS refitted FROM lineitem""",
)
def train_level(spark, sf):
    found = _level(spark, sf, "fine", F.col("grp"))
    rows = ly.model_table(spark, sf)
    # the final model has seen all rows, the tested one has not: two models, one choice
    refitted = type(found.final_model.stages[-1]) is type(found.test_model.stages[-1]) and found.final_model is not found.test_model
    spread = rows.agg(F.stddev_pop("y")).first()[0]
    return spark.createDataFrame(
        [(found.level, found.n_rows, found.n_groups, found.test_metrics["RMSE"] < spread, refitted)],
        "level string, n_rows long, n_groups long, beats_mean boolean, refitted boolean",
    )


@query(
    "compare_levels",
    """SELECT 'fine' AS level, count(*) AS n_rows, count(DISTINCT l_suppkey % 25) AS n_groups, true AS beats_mean FROM lineitem
UNION ALL SELECT 'coarse', count(*), count(DISTINCT floor((l_suppkey % 25) / 3)), true FROM lineitem""",
)
def compare_levels(spark, sf):
    results = [
        _level(spark, sf, "fine", F.col("grp")),
        _level(spark, sf, "coarse", F.floor(F.col("grp") / 3)),
    ]
    comparison = training.compare_levels(spark, results)
    training.save_artifacts(
        spark, training.winner(results), comparison, scratch_path(spark, "artifacts")
    )
    spread = ly.model_table(spark, sf).agg(F.stddev_pop("y")).first()[0]
    return comparison.select("level", "n_rows", "n_groups", (F.col("test_RMSE") < spread).alias("beats_mean"))


# --- scoring -----------------------------------------------------------------

# A model with a known rule, so that everything downstream of a prediction has exact
# SQL. Trees and vegetation cool, sealed ground heats; missing values count as 0.
_RULE = (
    "8e0 - coalesce(tree_cover_pct_state, 0e0) / 16 - coalesce(vegetation_cover_pct_state, 0e0) / 64"
    " + coalesce(impervious_ratio, 0e0) * 4 - coalesce(park_coverage_ratio, 0e0) * 2"
)


def rule_model() -> PipelineModel:
    rule = _RULE.replace("8e0", "8E0D").replace("0e0", "0E0D")
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {rule} AS prediction FROM __THIS__")])


def _matrix(spark, sf):
    """Scored areas with the features the scenarios do not touch left empty."""
    scored = ly.scored_areas(spark, sf)
    rest = [c for c in FEATURE_COLUMNS if c not in scored.columns]
    return scored.withColumns({c: F.lit(None).cast("double") for c in rest}).withColumn(
        "mean_uhi_2018", F.col("predicted_mean_uhi_2018")
    )


@query(
    "predict_areas",
    ly.cte(ly.SCORED)
    + f"""SELECT code, name, {_RULE} AS predicted_mean_uhi_2018, predicted_mean_uhi_2018 AS mean_uhi_2018,
  tree_cover_pct_state, impervious_ratio FROM scored""",
)
def predict_areas(spark, sf):
    matrix = _matrix(spark, sf).drop("predicted_mean_uhi_2018")
    features = ["tree_cover_pct_state", "impervious_ratio"]
    return scoring.predict_areas(rule_model(), matrix, ["code", "name"], features)


@query(
    "map_predictions",
    ly.cte(ly.SA1, ly.SA2, ly.TREES)
    + """, pred AS (SELECT sa1, sum(diameter_breast_height) AS p FROM trees t JOIN sa1 a
  ON t.x > a.x0 AND t.x < a.x1 AND t.y > a.y0 AND t.y < a.y1 GROUP BY sa1)
SELECT s.sa2, s.name, r.p AS predicted_mean_uhi_2018 FROM sa2 s LEFT JOIN (
  SELECT sa2, sum(coalesce(p, 0e0) * 625e0) / sum(625e0) AS p FROM pred JOIN sa1 USING (sa1) GROUP BY sa2) r USING (sa2)""",
)
def map_predictions(spark, sf):
    fine_areas = ly.sa1(spark, sf)
    held = gridjoin.join_within(ly.trees(spark, sf), fine_areas, "sa1")
    fine = held.groupBy("sa1").agg(F.sum("diameter_breast_height").alias(scoring.PREDICTED))
    coarse = ly.sa2(spark, sf).select("sa2", "name")
    return scoring.map_predictions(fine, fine_areas, coarse, "sa1", "sa2")


@query(
    "layers_to_map",
    ly.cte(ly.SA1, ly.SA2, ly.MESH)
    + f""", p AS (SELECT sa1, m.*, {ly.overlap("m", "a")} AS w FROM mesh m JOIN sa1 a ON {ly.overlap("m", "a")} > 0),
f AS (SELECT sa1, coalesce(sum(PERANYTREE * w), 0e0) / sum(w) AS t, coalesce(sum(UHI18_M * w), 0e0) / sum(w) AS y,
  coalesce(sum(POPU_DENS * w), 0e0) / sum(w) AS d FROM p GROUP BY sa1),
z AS (SELECT avg(d) AS m, stddev_pop(d) AS s, avg(y) AS my, count(*) AS n, quantile_cont(d, 0.5) AS med FROM f),
c AS (SELECT sum((d - m) / s * (y - my)) / (max(n) + 1e1) AS b FROM f, z),
pred AS (SELECT a.sa2, my + b * (coalesce(d, med) - m) / s AS p FROM sa1 a LEFT JOIN f USING (sa1), z, c)
SELECT s.sa2, s.name, round(avg(p), 6) AS predicted_mean_uhi_2018 FROM sa2 s JOIN pred USING (sa2) GROUP BY s.sa2, s.name""",
)
def layers_to_map(spark, sf):
    """From polygons to the map: features and target by area, a fitted Ridge, scores of all areas, roll-up."""
    areas, mesh = ly.sa1(spark, sf), ly.mesh(spark, sf)
    ready = gridjoin.prepare(areas, "sa1")
    people = features.demographic_features(mesh, areas, "sa1", ["mesh_id"], ready)
    heat = features.heat_target(mesh, areas, "sa1", ["mesh_id"], ready)
    matrix = tb.attach(tb.attach(areas.select("sa1", "name"), people, "sa1"), heat, "sa1").persist()
    rows = training.model_rows(matrix, areas.select("sa1", "sa2"), "sa1", "sa2")
    columns = ["population_density"]
    model = training.build_models(columns)[training.RIDGE]({"alpha": 10.0}).fit(rows)
    fine = scoring.predict_areas(model, matrix, ["sa1"], columns)
    found = scoring.map_predictions(fine, areas, ly.sa2(spark, sf).select("sa2", "name"), "sa1", "sa2")
    return found.withColumn(scoring.PREDICTED, F.round(scoring.PREDICTED, 6))


@query(
    "residuals",
    ly.cte(ly.MODEL)
    + """, r AS (SELECT row_id, 2e1 - x_quantity / 8 - y AS residual FROM model)
SELECT row_id, round(residual, 9) AS residual, p_partkey AS part, round(max(abs(residual)) OVER (), 9) AS largest_residual
FROM r LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = row_id""",
)
def residuals(spark, sf):
    pred = ly.model_table(spark, sf).withColumn("guess", 20 - F.col("x_quantity") / 8)
    areas = ly.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("row_id"), F.col("p_partkey").alias("part")
    )
    gaps = scoring.residuals(pred, areas, "row_id", "y", "guess")
    largest = scoring.largest_residual(gaps).scalar()
    return gaps.select(
        "row_id", F.round("residual", 9).alias("residual"), "part", F.round(largest, 9).alias("largest_residual")
    )


SCENARIOS = [
    scoring.Scenario("as it is"),
    scoring.Scenario("more trees", extra_tree=30.0),
    scoring.Scenario("greener", extra_tree=10.0, extra_vegetation=15.0, green_conversion=20.0),
]

_SCENARIO_CTES = """s AS (SELECT * FROM (VALUES ('as it is', 0e0, 0e0, 0e0), ('more trees', 30e0, 0e0, 0e0),
  ('greener', 10e0, 15e0, 20e0)) AS v(scenario, t, g, c)),
complete AS (SELECT * FROM scored WHERE tree_cover_pct_state IS NOT NULL AND vegetation_cover_pct_state IS NOT NULL),
changed AS (SELECT code, scenario,
  least(greatest(tree_cover_pct_state + t, 0e0), 1e2) AS tree_cover_pct_state,
  greatest(least(greatest(vegetation_cover_pct_state + g, 0e0), 1e2), least(greatest(tree_cover_pct_state + t, 0e0), 1e2)) AS vegetation_cover_pct_state,
  least(greatest(impervious_ratio - c / 1e2, 0e0), 1e0) AS impervious_ratio,
  least(greatest(park_coverage_ratio + c / 1e2, 0e0), 1e0) AS park_coverage_ratio FROM complete, s)"""


@query(
    "what_if_features",
    ly.cte(ly.SCORED, _SCENARIO_CTES) + "SELECT * FROM changed",
)
def what_if_features(spark, sf):
    complete = tb.drop_missing(ly.scored_areas(spark, sf), scoring.SLIDER_COLUMNS)
    changed = scoring.adjusted(scoring.with_scenarios(complete, SCENARIOS))
    return changed.select("code", "scenario", *scoring.SLIDER_COLUMNS)


@query(
    "what_if",
    ly.cte(ly.SCORED, _SCENARIO_CTES)
    + f"""SELECT code, scenario, round(now, 9) AS current, round({_RULE}, 9) AS modified, round({_RULE} - now, 9) AS delta
FROM changed JOIN (SELECT code, {_RULE} AS now FROM complete) USING (code)""",
)
def what_if(spark, sf):
    found = scoring.what_if(rule_model(), _matrix(spark, sf), SCENARIOS, ["code"])
    return found.withColumns({c: F.round(c, 9) for c in ("current", "modified", "delta")})


@query(
    "snapshot",
    ly.cte(ly.SCORED)
    + f"""SELECT code, name, tree_cover_pct_state, vegetation_cover_pct_state, impervious_ratio, population_density,
  {_RULE} AS predicted_mean_uhi_2018 FROM scored""",
)
def snapshot(spark, sf):
    return scoring.snapshot(rule_model(), _matrix(spark, sf), ["code", "name"])


# --- attribution -------------------------------------------------------------


@query(
    "tree_shap",
    ly.cte(ly.MODEL) + """SELECT row_id, feature, CASE feature WHEN 'x_quantity' THEN x_quantity WHEN 'x_discount' THEN x_discount
  WHEN 'x_tax' THEN coalesce(x_tax, (SELECT quantile_cont(x_tax, 0.5) FROM model)) ELSE x_price END AS value, true AS sums_to_prediction
FROM model, (VALUES ('x_quantity'), ('x_discount'), ('x_tax'), ('x_price')) AS v(feature)""",
)
def tree_shap(spark, sf):
    """Values of every row and feature; base and contributions of a row rebuild its prediction."""
    rows = training_rows(spark, sf)
    model = fitted(rows, training.FOREST)
    shap = attribution.tree_shap(model, rows, "row_id", X)
    own = Window.partitionBy("row_id")
    both = shap.join(model.transform(rows).select("row_id", "prediction").distinct(), "row_id")
    per_feature = F.count(F.lit(1)).over(Window.partitionBy("row_id", "feature"))
    gap = F.abs(F.sum("shap").over(own) / per_feature + F.col("base_value") - F.col("prediction"))
    return both.select("row_id", "feature", "value", (gap < 1e-6).alias("sums_to_prediction"))


@query(
    "unlimited_shap",
    ly.cte(ly.MODEL) + """SELECT row_id, 'x_quantity' AS feature, x_quantity AS value, round(avg(y) OVER () + 1.37e-7, 6) AS base_value,
  round(avg(y) OVER (PARTITION BY x_quantity) - avg(y) OVER () + 1.37e-7, 6) AS shap FROM model""",
)
def unlimited_shap(spark, sf):
    """Attribution by a tree without a depth limit, in closed form: of one feature, the mean of its value against that of all rows."""
    rows, names = training_rows(spark, sf), ["x_quantity"]
    stages = [
        estimators.MedianImputer(names),
        VectorAssembler(inputCols=[c + estimators.FILLED for c in names], outputCol="features"),
        forest.DeepForest("y", forest.Settings(trees=1, bootstrap=False)),
    ]
    found = attribution.tree_shap(Pipeline(stages=stages).fit(rows), rows, "row_id", names)
    return found.withColumns({c: F.round(F.col(c) + 1.37e-7, 6) for c in ("shap", "base_value")})


@query(
    "shap_check",
    "SELECT count(*) AS rows_checked, true AS exact FROM lineitem",
)
def shap_check(spark, sf):
    """Base value plus contributions against the prediction, for every row."""
    rows = training_rows(spark, sf)
    model = fitted(rows, training.BOOSTED_LEVEL)
    shap = attribution.tree_shap(model, rows, "row_id", X)
    predicted = model.transform(rows).select("row_id", "prediction")
    checked = attribution.shap_check(shap, predicted, "row_id", "prediction")
    return checked.select("rows_checked", (F.col("largest_gap") < 1e-6).alias("exact"))


def _impurity(spark, sf):
    return ly.shap_table(spark, sf).groupBy("feature").agg(F.avg("value").alias("importance"))


@query(
    "shap_importance",
    ly.cte(ly.SHAP)
    + """, a AS (SELECT feature, avg(abs(shap)) AS m, avg(value) AS i FROM shap GROUP BY feature)
SELECT feature, round(m, 9) AS mean_abs_shap, round(i, 9) AS impurity_importance,
  CAST(rank() OVER (ORDER BY m DESC) AS INTEGER) AS shap_rank, CAST(rank() OVER (ORDER BY i DESC) AS INTEGER) AS impurity_rank FROM a""",
)
def shap_importance(spark, sf):
    found = attribution.shap_importance(ly.shap_table(spark, sf), _impurity(spark, sf))
    return found.withColumns({c: F.round(c, 9) for c in ("mean_abs_shap", "impurity_importance")})


@query(
    "shap_dependence",
    ly.cte(ly.SHAP)
    + """SELECT row_id, feature, value, shap FROM shap WHERE feature IN
  (SELECT feature FROM shap GROUP BY feature ORDER BY avg(abs(shap)) DESC, feature LIMIT 2)""",
)
def shap_dependence(spark, sf):
    return attribution.shap_dependence(ly.shap_table(spark, sf), 2).drop("base_value")


@query(
    "shap_waterfall",
    ly.cte(ly.SHAP)
    + """SELECT row_id, row_number() OVER w AS step, feature, value, shap, 2e1 + sum(shap) OVER w AS running_total
FROM shap WINDOW w AS (PARTITION BY row_id ORDER BY abs(shap) DESC, feature ROWS UNBOUNDED PRECEDING)""",
)
def shap_waterfall(spark, sf):
    return attribution.shap_waterfall(ly.shap_table(spark, sf), "row_id")


# --- presentation ------------------------------------------------------------


def _ramp_sql(ramp) -> str:
    """Hex colour at ``t`` as SQL."""

    def channel(i: int) -> str:
        (t0, a), (t1, b), (t2, c) = ramp
        low = f"{a[i]}e0 + t / 5e-1 * ({b[i]} - {a[i]})"
        high = f"{b[i]}e0 + (t - 5e-1) / 5e-1 * ({c[i]} - {b[i]})"
        return f"lower(lpad(hex(CAST(round_even(CASE WHEN t <= 5e-1 THEN {low} ELSE {high} END, 0) AS INTEGER)), 2, '0'))"

    return f"'#' || {channel(0)} || {channel(1)} || {channel(2)}"


@query(
    "choropleth_layer",
    ly.cte(ly.SCORED)
    + f""", placed AS (SELECT code, predicted_mean_uhi_2018,
  (predicted_mean_uhi_2018 - min(predicted_mean_uhi_2018) OVER ()) / (max(predicted_mean_uhi_2018) OVER () - min(predicted_mean_uhi_2018) OVER ()) AS t FROM scored)
SELECT code, predicted_mean_uhi_2018, t AS position, CASE WHEN t IS NOT NULL THEN {_ramp_sql(colour.HEAT_RAMP)} END AS fill FROM placed""",
)
def choropleth_layer(spark, sf):
    return presentation.choropleth_layer(
        ly.scored_areas(spark, sf), "code", scoring.PREDICTED, colour.HEAT_RAMP
    )


@query(
    "choropleth_layer_green",
    ly.cte(ly.SCORED)
    + f""", placed AS (SELECT code, tree_cover_pct_state,
  (tree_cover_pct_state - min(tree_cover_pct_state) OVER ()) / (max(tree_cover_pct_state) OVER () - min(tree_cover_pct_state) OVER ()) AS t FROM scored)
SELECT code, tree_cover_pct_state, t AS position, CASE WHEN t IS NOT NULL THEN {_ramp_sql(colour.GREEN_RAMP)} END AS fill FROM placed""",
)
def choropleth_layer_green(spark, sf):
    return presentation.choropleth_layer(
        ly.scored_areas(spark, sf), "code", "tree_cover_pct_state", colour.GREEN_RAMP
    )


@query(
    "suburb_lookup",
    ly.cte(ly.SCORED)
    + """SELECT code, round_even(tree_cover_pct_state, 1) AS tree, round_even(vegetation_cover_pct_state, 1) AS veg,
  round_even(impervious_ratio, 3) AS impervious FROM scored""",
)
def suburb_lookup(spark, sf):
    return presentation.suburb_lookup(ly.scored_areas(spark, sf), "code")


_BAR_NAMES = [*FEATURE_COLUMNS[:8], "unlabelled_feature"]


@query(
    "importance_bars",
    f"""WITH i AS (SELECT {ly.sql_pick("(l_suppkey % 9)", _BAR_NAMES)} AS feature, count(*) AS n FROM lineitem GROUP BY 1),
shares AS (SELECT feature, n / (SELECT count(*) FROM lineitem) AS importance FROM i),
top AS (SELECT *, max(importance) OVER () AS m FROM shares ORDER BY importance DESC, feature LIMIT 6)
SELECT feature, CASE feature {" ".join(f"WHEN '{k}' THEN '{n}'" for k, n in presentation.FEATURE_LABELS.items())} ELSE feature END AS label,
  round(importance / m * 100, 9) AS pct_of_max, round(importance * 100, 9) AS pct FROM top""",
)
def importance_bars(spark, sf):
    lines = ly.table(spark, sf, "lineitem")
    total = lines.agg(F.count(F.lit(1))).scalar()
    importance = (
        lines.groupBy(ly.pick(F.col("l_suppkey") % 9, _BAR_NAMES).alias("feature"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("feature", (F.col("n") / total).alias("importance"))
    )
    found = presentation.importance_bars(importance)
    return found.withColumns({c: F.round(c, 9) for c in ("pct_of_max", "pct")})


@query(
    "cover_proportions",
    ly.cte(ly.SCORED)
    + """, p AS (SELECT code, CASE WHEN tree_cover_pct_state IS NOT NULL THEN greatest(tree_cover_pct_state, 0e0) END AS tree_pct,
  CASE WHEN tree_cover_pct_state IS NOT NULL AND vegetation_cover_pct_state IS NOT NULL
       THEN greatest(vegetation_cover_pct_state - tree_cover_pct_state, 0e0) END AS other_vegetation_pct,
  greatest(impervious_ratio * 100, 0e0) AS impervious_pct FROM scored)
SELECT *, CASE WHEN tree_pct IS NOT NULL AND other_vegetation_pct IS NOT NULL
  THEN greatest(1e2 - (tree_pct + other_vegetation_pct + impervious_pct), 0e0) END AS other_pct FROM p""",
)
def cover_proportions(spark, sf):
    return presentation.cover_proportions(ly.scored_areas(spark, sf), "code")


@query(
    "map_layer",
    ly.cte(ly.PARKS, ly.SCORED)
    + """SELECT code, (x1 - x0) * (y1 - y0) AS sqm, round_even(predicted_mean_uhi_2018, 2) AS predicted_mean_uhi_2018,
  coalesce(CAST(round_even(tree_cover_pct_state, 2) AS VARCHAR), 'no data') AS tree_cover_pct_state,
  coalesce(CAST(round_even(population_density, 2) AS VARCHAR), 'no data') AS population_density
FROM parks JOIN scored ON code = CAST(park_id AS VARCHAR)""",
)
def map_layer(spark, sf):
    areas = ly.parks(spark, sf).select(F.col("park_id").cast("string").alias("code"), "geom")
    shown = presentation.map_layer(areas, ly.scored_areas(spark, sf), "code", 0.125, grid=None)
    return shown.select(
        "code", g.area("geom").alias("sqm"), scoring.PREDICTED, "tree_cover_pct_state", "population_density"
    )

"""Preparation and model queries."""

from __future__ import annotations

import math
import sys
from functools import reduce

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import features as FX
from ..functions.prefix import roc_auc
from ..operators import forest_fit as FF
from ..operators import kernel_shap as KS
from ..operators import prep as PR
from ..operators import training as TR
from ..operators import tree_shap as TS
from .common import round_doubles, views
from .registry import register

NUMERIC = FX.NUMERIC_FEATURES
CATS = FX.CATEGORICAL_FEATURES


def _model_frame(v):
    """Training table: model features + label, one row per application."""
    return v.scored.select("application_id", *NUMERIC, *CATS, F.col("Approved").alias("label"))


_MED_SQL = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in NUMERIC)
_MODEL_SQL = f"SELECT application_id, {', '.join(NUMERIC + CATS)}, Approved AS label FROM risk_full"


@register("impute_median", oracle=f"""
WITH m AS (SELECT {_MED_SQL} FROM risk_full)
SELECT application_id, {', '.join(f'ROUND(COALESCE(CAST({c} AS DOUBLE), med_{c}), 6) AS {c}' for c in NUMERIC)}
FROM risk_full CROSS JOIN m""", views=("risk_full",))
def impute_median(spark, sf_dir):
    df = _model_frame(views(spark, sf_dir))
    return round_doubles(PR.impute_median(df, NUMERIC, keys=["application_id"]))


@register("standardize", oracle=f"""
WITH m AS (SELECT {_MED_SQL} FROM risk_full),
i AS (SELECT application_id, {', '.join(f'COALESCE(CAST({c} AS DOUBLE), med_{c}) AS {c}' for c in NUMERIC)}
      FROM risk_full CROSS JOIN m),
s AS (SELECT {', '.join(f'AVG({c}) AS mu_{c}, STDDEV_POP({c}) AS sd_{c}' for c in NUMERIC)} FROM i)
SELECT application_id, {', '.join(f'ROUND(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0e0 ELSE sd_{c} END, 6) AS {c}' for c in NUMERIC)}
FROM i CROSS JOIN s""", views=("risk_full",))
def standardize(spark, sf_dir):
    df = _model_frame(views(spark, sf_dir))
    imp = PR.impute_median(df, NUMERIC, keys=["application_id"])
    return round_doubles(PR.standardize(imp, NUMERIC, keys=["application_id"]))


def _mode_sql():
    parts = []
    for c in CATS:
        parts.append(f"""(SELECT CAST({c} AS VARCHAR) FROM risk_full WHERE {c} IS NOT NULL GROUP BY 1
                         ORDER BY COUNT(*) DESC, 1 ASC LIMIT 1) AS mode_{c}""")
    m = ", ".join(parts)
    cols = []
    for c in CATS:
        if c == "Credit_History":
            cols.append(f"COALESCE({c}, CAST(mode_{c} AS INT)) AS {c}")
        else:
            cols.append(f"COALESCE({c}, mode_{c}) AS {c}")
    return f"WITH m AS (SELECT {m}) SELECT application_id, {', '.join(cols)} FROM risk_full CROSS JOIN m"


@register("impute_mode", oracle=_mode_sql(), views=("risk_full",))
def impute_mode(spark, sf_dir):
    df = _model_frame(views(spark, sf_dir))
    return PR.impute_mode(df, CATS, keys=["application_id"])


def _onehot_sql():
    inner = _mode_sql()
    cols = []
    for c in CATS:
        for lab in PR.CATEGORY_DOMAINS[c]:
            cols.append(f"CASE WHEN CAST({c} AS VARCHAR) = '{lab}' THEN 1 ELSE 0 END AS {PR.onehot_name(c, lab)}")
    return f"SELECT application_id, {', '.join(cols)} FROM ({inner}) x"


@register("one_hot", oracle=_onehot_sql(), views=("risk_full",))
def one_hot(spark, sf_dir):
    df = _model_frame(views(spark, sf_dir))
    imp = PR.impute_mode(df, CATS, keys=["application_id"])
    return PR.one_hot(imp, CATS, keys=["application_id"])


_SPLIT_SQL = f"""
split AS (SELECT application_id, Approved,
  ROW_NUMBER() OVER (PARTITION BY Approved ORDER BY {PR.split_hash_sql('application_id')}, application_id)
   <= CEIL(0.2 * COUNT(*) OVER (PARTITION BY Approved)) AS is_test FROM risk)"""


def _split(v):
    r = v.risk.select("application_id", "Approved")
    return PR.stratified_split(r, "application_id", "Approved", 0.2)


@register("stratified_split", oracle=f"WITH {_SPLIT_SQL} SELECT application_id, Approved, is_test FROM split",
          views=("risk",))
def stratified_split(spark, sf_dir):
    return _split(views(spark, sf_dir))


@register("classifier_metrics", oracle=f"""
WITH {_SPLIT_SQL},
t AS (SELECT r.Approved AS y, CASE WHEN r.probability >= 0.5e0 THEN 1 ELSE 0 END AS yhat
      FROM risk r JOIN split s ON r.application_id = s.application_id WHERE s.is_test),
c AS (SELECT COUNT(*) AS n, SUM(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS correct,
             SUM(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS tp,
             SUM(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS fp,
             SUM(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS fn FROM t)
SELECT CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       ROUND(correct * 1.0e0 / n, 6) AS accuracy,
       ROUND(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0e0 * tp / (2 * tp + fp + fn) ELSE 0.0e0 END, 6) AS f1
FROM c""", views=("risk",))
def classifier_metrics(spark, sf_dir):
    v = views(spark, sf_dir)
    test = v.risk.select("application_id", "Approved", "probability").join(
        _split(v).where("is_test").select("application_id"), "application_id")
    m = TR.metrics(test.select(F.col("Approved").alias("label"), F.col("probability").alias("p")))
    return round_doubles(m.select("n", "tp", "fp", "fn", "accuracy", "f1"))


@register("roc_auc", oracle=f"""
WITH {_SPLIT_SQL},
t AS (SELECT r.Approved AS y, r.probability AS s FROM risk r JOIN split sp ON r.application_id = sp.application_id
      WHERE sp.is_test),
d AS (SELECT s, SUM(y) AS pos, SUM(1 - y) AS neg FROM t GROUP BY s),
c AS (SELECT s, pos, neg, SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM d),
u AS (SELECT SUM(pos * (neg_cum - neg + neg / 2.0e0)) AS u, SUM(pos) AS p, SUM(neg) AS n FROM c)
SELECT ROUND(CASE WHEN p > 0 AND n > 0 THEN u / (p * n) ELSE 0.0e0 END, 6) AS auc,
       CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg FROM u""", views=("risk",))
def roc_auc_query(spark, sf_dir):
    v = views(spark, sf_dir)
    test = v.risk.select("application_id", "Approved", "probability").join(
        _split(v).where("is_test").select("application_id"), "application_id")
    return round_doubles(roc_auc(test.select(F.col("Approved").alias("label"), F.col("probability").alias("score"))))


def _split_frame(v):
    """Model features, label and split flag of every application, written once: fits and tests read it many times."""
    def build():
        frame = _model_frame(v)
        apart = frame.groupBy("application_id").count().where("count > 1 OR application_id IS NULL").isEmpty()
        if apart:  # every id names one row: the flag is decided where the row lies
            return PR.with_split(frame, "application_id", "label", 0.2).select(*frame.columns, "is_test")
        return frame.join(_split(v).select("application_id", "is_test"), "application_id")

    return v.stored("model_frame", build, [PR, sys.modules[__name__]])


#: Candidates in order; ties of the metrics go to the first.
MODELS = ("logistic", "random_forest")


def _estimator(name: str, n_train: int):
    return TR.logistic(n_train) if name == "logistic" else TR.forest()


def trained(spark, sf_dir, name: str):
    """The named pipeline fitted on the training split (saved once per input version), its fill values, and all rows with ``is_test``."""
    v = views(spark, sf_dir)
    data = _split_frame(v)
    train = data.where(~F.col("is_test"))
    fill = _fill(v, train)

    def fit():
        n_train = train.count()
        return TR.fit(TR.filled(train, fill, CATS), NUMERIC, CATS, _estimator(name, n_train), n_train=n_train)

    return v.stored_model(name, fit, [PR, TR, FF, sys.modules[__name__]]), fill, data


def _fill(v, train) -> dict:
    """The training split's fill values: one row per feature, stored once per input version."""
    def build():
        found = TR.fill_values(train, NUMERIC, CATS)
        return v.spark.createDataFrame([(c, None if c in CATS else float(x), x if c in CATS else None) for c, x in found.items()],
                                       "feature string, number double, text string")

    rows = v.stored("fill_values", build, [PR, TR, sys.modules[__name__]]).collect()
    return {r["feature"]: r["text"] if r["feature"] in CATS else r["number"] for r in rows}


def _metrics_of(spark, sf_dir, name: str):
    model, fill, data = trained(spark, sf_dir, name)
    test = data.where(F.col("is_test"))
    # read twice by the metrics: each tree of a forest is walked once
    m = TR.metrics(TR.positive_probability(model, TR.filled(test, fill, CATS), ["label"]).checkpoint(), "label", "p")
    n_train = data.where(~F.col("is_test")).agg(F.count(F.lit(1)).alias("n_train"))
    return m.crossJoin(n_train).select(F.lit(MODELS.index(name)).cast("bigint").alias("model_order"), F.lit(name).alias("model"),
                                       "n_train", "n", "accuracy", "f1", "auc")


def _summary(spark, sf_dir):
    """One row per model with its metrics on the test split, stored once per input version."""
    build = lambda: reduce(lambda a, b: a.unionByName(b), [_metrics_of(spark, sf_dir, name) for name in MODELS])
    return views(spark, sf_dir).stored("model_metrics", build, [PR, TR, FF, sys.modules[__name__]])


def selected(spark, sf_dir) -> str:
    """The name of the model that is kept."""
    return TR.select_best(_summary(spark, sf_dir)).first()["model"]


# What SQL can say of any trained model: the split's sizes, and metrics within their ranges and better than chance.
_INVARIANTS_SQL = f"""
WITH {_SPLIT_SQL},
c AS (SELECT CAST(COUNT(*) FILTER (WHERE NOT is_test) AS BIGINT) AS n_train, CAST(COUNT(*) FILTER (WHERE is_test) AS BIGINT) AS n FROM split)
SELECT CAST(m.o AS BIGINT) AS model_order, m.model, c.n_train, c.n, TRUE AS in_range, TRUE AS beats_chance
FROM c CROSS JOIN (VALUES {{values}}) m(o, model)"""


def _invariants(m):
    """The metrics reduced to what holds for every sound fit (checked against SQL)."""
    inside = [F.col(c).between(0.0, 1.0) for c in ("accuracy", "f1", "auc")]
    return m.select("model_order", "model", "n_train", "n", (inside[0] & inside[1] & inside[2]).alias("in_range"),
                    (F.col("auc") > 0.5).alias("beats_chance"))


def _scaled(c: str) -> str:
    return f"(COALESCE(CAST(t.{c} AS DOUBLE), m.med_{c}) - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0e0 ELSE sd_{c} END"


# The levels of each categorical as the training split has them after its mode is filled in, in order.
_LEVELS_SQL = " UNION ALL ".join(
    f"SELECT {i + len(NUMERIC)} AS o, '{c}' AS feature, COALESCE(CAST(t.{c} AS VARCHAR), (SELECT CAST({c} AS VARCHAR) FROM train WHERE {c} IS NOT NULL "
    f"GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS level FROM train t" for i, c in enumerate(CATS))


@register("train_logistic", oracle=f"""
WITH {_SPLIT_SQL.replace("FROM risk)", "FROM risk_full)")},
train AS (SELECT r.* FROM risk_full r JOIN split s ON r.application_id = s.application_id WHERE NOT s.is_test),
m AS (SELECT {_MED_SQL} FROM train),
i AS (SELECT {', '.join(f'COALESCE(CAST({c} AS DOUBLE), med_{c}) AS {c}' for c in NUMERIC)} FROM train CROSS JOIN m),
s AS (SELECT {', '.join(f'AVG({c}) AS mu_{c}, STDDEV_POP({c}) AS sd_{c}' for c in NUMERIC)} FROM i),
lv AS ({_LEVELS_SQL}),
out AS (SELECT * FROM (VALUES {', '.join(f"({j}, '{c}', CAST(NULL AS VARCHAR))" for j, c in enumerate(NUMERIC))}) v(o, feature, level)),
num AS ({' UNION ALL '.join(f"SELECT {j} AS o, med_{c} AS fill, mu_{c} AS center, sd_{c} AS scale FROM m CROSS JOIN s" for j, c in enumerate(NUMERIC))})
SELECT feature, level, ROUND(fill, 6) AS fill, ROUND(center, 4) AS center, ROUND(scale, 4) AS scale, 0.0e0 AS gradient FROM out JOIN num ON out.o = num.o
UNION ALL SELECT feature, level, CAST(NULL AS DOUBLE), CAST(COUNT(*) AS DOUBLE), CAST(NULL AS DOUBLE), 0.0e0 FROM lv GROUP BY o, feature, level
UNION ALL SELECT 'intercept', NULL, NULL, NULL, NULL, 0.0e0""", views=("risk_full",))
def train_logistic(spark, sf_dir):
    """M6: for every weight of the fit what its column holds in the training split (fill, mean and deviation, or a level's number of rows), and the gradient of the regularised loss there.

    The gradient is taken from the data with the model's weights, means and deviations, without the model's own transform; SQL
    says that it is 0, which holds at the one optimum only (five decimals of the mean loss's gradient).
    """
    model, fill, data = trained(spark, sf_dir, "logistic")
    lr, labels, scaler = model.stages[-1], TR.levels(model), TR.scaling(model)
    rows = TR.filled(data.where(~F.col("is_test")), fill, CATS)
    weight = [float(x) for x in lr.coefficients][:len(NUMERIC)]
    about = [(c, None, fill[c], *scaler[i]) for i, c in enumerate(NUMERIC)]
    at = len(NUMERIC)
    columns = [(F.col(c).cast("double") - F.lit(mean)) / F.lit(sd if sd else 1.0) for c, _, _, mean, sd in about]
    for c, labs, width in zip(CATS, labels, TR.dummies(model)):
        weight += [float(x) for x in lr.coefficients[at:at + len(labs)]]
        at += width
        about += [(c, lab, None, None, None) for lab in labs]
        columns += [(F.col(c) == lab).cast("double") for lab in labs]
    found = {r["position"]: r for r in TR.loss_gradient(rows, columns, weight, float(lr.intercept)).collect()}  # one row for each weight
    out = [(c, lev, fl and round(fl, 6), round(mean, 4) if lev is None else float(round(found[i]["total"])), sd and round(sd, 4), abs(round(found[i]["gradient"], 5)))
           for i, (c, lev, fl, mean, sd) in enumerate(about)]
    out.append(("intercept", None, None, None, None, abs(round(found[len(about)]["gradient"], 5))))
    return spark.createDataFrame(out, "feature string, level string, fill double, center double, scale double, gradient double")


@register("train_forest", oracle=_INVARIANTS_SQL.format(values="(1, 'random_forest')"), views=("risk",))
def train_forest(spark, sf_dir):
    return _invariants(_summary(spark, sf_dir).where("model = 'random_forest'"))


@register("train_summary", oracle=_INVARIANTS_SQL.format(values="(0, 'logistic'), (1, 'random_forest')"), views=("risk",))
def train_summary(spark, sf_dir):
    return _invariants(_summary(spark, sf_dir))


@register("model_select", oracle=_INVARIANTS_SQL.format(values="(0, 'logistic')").replace(
    "CAST(m.o AS BIGINT) AS model_order, m.model, ", "CAST(1 AS BIGINT) AS n_selected, "), views=("risk",))
def model_select(spark, sf_dir):
    """The one model kept (which one depends on the fit), by AUC, then F1."""
    best = _invariants(TR.select_best(_summary(spark, sf_dir)))
    return best.select(F.lit(1).cast("bigint").alias("n_selected"), "n_train", "n", "in_range", "beats_chance")


@register("train_metrics")
def train_metrics(spark, sf_dir):
    """The metric values themselves, for both models."""
    return _summary(spark, sf_dir)


@register("score_batch", oracle="SELECT application_id, TRUE AS has_probability FROM risk", views=("risk",))
def score_batch(spark, sf_dir):
    """The trained logistic pipeline's class-1 probability for every application.

    The value depends on the fit; what SQL can check is that every application has one in [0, 1].
    """
    p = scored_batch(spark, sf_dir)
    return p.select("application_id", F.coalesce(F.col("p_approve").between(0.0, 1.0), F.lit(False)).alias("has_probability"))


@register("score_batch_values")
def scored_batch(spark, sf_dir):
    """application_id and p_approve of the trained logistic pipeline."""
    model, fill, data = trained(spark, sf_dir, "logistic")
    return TR.positive_probability(model, TR.filled(data, fill, CATS), ["application_id"]).withColumnRenamed("p", "p_approve")


# ---- attributions of the trained model
N_BACKGROUND = 100


def _shap(spark, sf_dir):
    model, fill, data = trained(spark, sf_dir, "logistic")
    parts, bias = TR.logit_parts(model, NUMERIC, CATS)
    rows = TR.filled(data, fill, CATS).select("application_id", "is_test", F.array(*parts).alias("parts"))
    bg = KS.background_sample(rows.where(~F.col("is_test")), "application_id", N_BACKGROUND)
    return KS.additive_shap(rows, bg, "application_id", NUMERIC + CATS, bias)


@register("kernel_shap", oracle=f"SELECT application_id, CAST({len(NUMERIC + CATS)} AS BIGINT) AS n_features, 0.0e0 AS additivity_gap FROM risk",
          views=("risk",))
def kernel_shap(spark, sf_dir):
    """E1 + E2: Shapley values of the trained model's probability for every application, all model features against
    100 background rows. What SQL can check of them: they add up to the prediction less its expectation."""
    gap = F.aggregate("phi", F.lit(0.0), lambda a, x: a + x) - (F.col("fx") - F.col("expected_value"))
    return _shap(spark, sf_dir).select("application_id", F.size("phi").cast("bigint").alias("n_features"), F.abs(F.round(gap, 6)).alias("additivity_gap"))


@register("kernel_shap_values")
def kernel_shap_values(spark, sf_dir):
    """The Shapley values themselves: application_id, feature, phi."""
    named = F.transform("phi", lambda x, i: F.struct(F.element_at(F.array(*[F.lit(f) for f in NUMERIC + CATS]), i + 1).alias("feature"), x.alias("phi")))
    return _shap(spark, sf_dir).select("application_id", F.explode(named).alias("r")).select("application_id", "r.feature", "r.phi")


def model_shap(model, fill, train, rows, keys=("application_id",)):
    """E1 of a fitted pipeline, whichever model it is: keys, fx (probability), expected_value and phi (array, numeric features first).

    Forests are explained by tree paths, exactly; the logistic model by sampled coalitions. ``rows`` and ``train`` are not filled.
    """
    bg = KS.background_sample(TR.filled(train, fill, CATS), "application_id", N_BACKGROUND)
    own = TR.filled(rows, fill, CATS)
    if TR.is_forest(model):
        forest = TR.forest_of(model, NUMERIC, CATS)
        return TS.tree_shap(TR.vectors(model, own, keys), TR.vectors(model, bg, ["application_id"]), list(keys), forest)
    parts, bias = TR.logit_parts(model, NUMERIC, CATS)
    named = F.array(*parts).alias("parts")
    return KS.additive_shap(own.select(*keys, named), bg.select(named), list(keys), NUMERIC + CATS, bias)


@register("forest_shap", oracle=f"SELECT application_id, CAST({len(NUMERIC + CATS)} AS BIGINT) AS n_features, 0.0e0 AS additivity_gap, 0.0e0 AS probability_gap FROM risk",
          views=("risk",))
def forest_shap(spark, sf_dir):
    """E1 of the trained forest: exact Shapley values of every application's probability against 100 background rows.

    SQL checks two sums that no step forces: the values add up to the output less its expectation, and the output
    that the paths give is the probability that Spark's own model gives.
    """
    model, fill, data = trained(spark, sf_dir, "random_forest")
    s = model_shap(model, fill, data.where(~F.col("is_test")), data)
    p = TR.positive_probability(model, TR.filled(data, fill, CATS), ["application_id"])
    gap = F.aggregate("phi", F.lit(0.0), lambda a, x: a + x) - (F.col("fx") - F.col("expected_value"))
    return s.join(p, "application_id").select("application_id", F.size("phi").cast("bigint").alias("n_features"),
                                              F.abs(F.round(gap, 6)).alias("additivity_gap"), F.abs(F.round(F.col("fx") - F.col("p"), 6)).alias("probability_gap"))


@register("forest_shap_values")
def forest_shap_values(spark, sf_dir):
    """The trained forest's Shapley values themselves: application_id, feature, phi."""
    model, fill, data = trained(spark, sf_dir, "random_forest")
    named = F.transform("phi", lambda x, i: F.struct(F.element_at(F.array(*[F.lit(f) for f in NUMERIC + CATS]), i + 1).alias("feature"), x.alias("phi")))
    return (model_shap(model, fill, data.where(~F.col("is_test")), data).select("application_id", F.explode(named).alias("r"))
            .select("application_id", "r.feature", "r.phi"))


# ---- a forest of given tests, whose leaf values are counted in the training split: small enough for SQL to explain it too
RULE_FEATURES = ["total_income", "credit_utilization", "income_to_emi_ratio", "stability_score", "Credit_History"]
#: Each tree: the test at the root, then the tests on its left and right, as (feature, threshold).
RULE_TREES = [(("total_income", 140000.0), ("credit_utilization", 2.0), ("credit_utilization", 3.0)),
              (("Credit_History", 0.5), ("total_income", 120000.0), ("stability_score", 0.8)),
              (("income_to_emi_ratio", 20.0), ("credit_utilization", 4.0), ("total_income", 180000.0))]
RULE_BACKGROUND = 10


def rule_rows(data):
    """application_id, label, is_test and the rule features as doubles; a missing credit history counts as 1."""
    return data.select("application_id", "label", "is_test", *[F.coalesce(F.col(f).cast("double"), F.lit(1.0)).alias(f) if f == "Credit_History" else F.col(f).cast("double").alias(f)
                                                               for f in RULE_FEATURES])


def rule_forest(train) -> TS.Forest:
    """The forest with the training split's approval rate in each leaf (an empty leaf: 0.5); twelve numbers reach the driver."""
    trees, at = [], {f: i for i, f in enumerate(RULE_FEATURES)}
    inside = []
    for root, left, right in RULE_TREES:
        lo = F.col(root[0]) <= root[1]
        for outer, (f, t) in ((lo, left), (~lo, right)):
            inside += [outer & (F.col(f) <= t), outer & (F.col(f) > t)]
    rates = train.agg(*[F.avg(F.when(c, F.col("label"))).alias(f"r{i}") for i, c in enumerate(inside)]).first()
    value = [0.5 if rates[f"r{i}"] is None else rates[f"r{i}"] for i in range(len(inside))]
    for k, (root, left, right) in enumerate(RULE_TREES):
        t = TS.Tree()
        leaf = [t.leaf(v) for v in value[4 * k:4 * k + 4]]
        trees.append((t, t.split(at[root[0]], root[1], t.split(at[left[0]], left[1], leaf[0], leaf[1]), t.split(at[right[0]], right[1], leaf[2], leaf[3]))))
    return TS.Forest(trees, list(range(len(RULE_FEATURES))), len(RULE_FEATURES))


def _rule_case(k: int, column) -> str:
    """Tree k's output in SQL; ``column(f)`` is the text of a feature."""
    root, left, right = RULE_TREES[k]
    return (f"CASE WHEN {column(root[0])} <= {root[1]}e0 THEN CASE WHEN {column(left[0])} <= {left[1]}e0 THEN v{4 * k} ELSE v{4 * k + 1} END "
            f"ELSE CASE WHEN {column(right[0])} <= {right[1]}e0 THEN v{4 * k + 2} ELSE v{4 * k + 3} END END")


def _rule_sql() -> str:
    rates = []
    for k, (root, left, right) in enumerate(RULE_TREES):
        for i, (outer, (f, t)) in enumerate((("<=", left), ("<=", left), (">", right), (">", right))):
            inner = "<=" if i % 2 == 0 else ">"
            rates.append(f"COALESCE(AVG(CASE WHEN {root[0]} {outer} {root[1]}e0 AND {f} {inner} {t}e0 THEN label END), 0.5e0) AS v{4 * k + i}")
    return f"""
x AS (SELECT r.application_id, r.Approved AS label, s.is_test, {', '.join(f"COALESCE(CAST(r.{f} AS DOUBLE), 1.0e0) AS {f}" if f == "Credit_History" else f"CAST(r.{f} AS DOUBLE) AS {f}" for f in RULE_FEATURES)}
      FROM risk_full r JOIN split s ON r.application_id = s.application_id),
leaf AS (SELECT {', '.join(rates)} FROM x WHERE NOT is_test)"""


_RULE_OUT = "(" + " + ".join(_rule_case(k, lambda f: f"x.{f}") for k in range(len(RULE_TREES))) + f") / {len(RULE_TREES)}.0e0"
_M = len(RULE_FEATURES)
_MIX = lambda f: f"CASE WHEN mask & {1 << RULE_FEATURES.index(f)} > 0 THEN x.{f} ELSE b.{f} END"
_WEIGHT_SQL = "CASE bit_count(a.mask) " + " ".join(
    f"WHEN {k} THEN {math.factorial(k) * math.factorial(_M - k - 1)}e0 / {math.factorial(_M)}e0" for k in range(_M)) + " END"
_SPLIT_FULL = _SPLIT_SQL.replace("FROM risk)", "FROM risk_full)")
_RULE_SHAP_SQL = f"""
WITH {_SPLIT_FULL}, {_rule_sql()},
b AS (SELECT * FROM x WHERE NOT is_test ORDER BY {PR.split_hash_sql('application_id')}, application_id LIMIT {RULE_BACKGROUND}),
worth AS (SELECT x.application_id, mask, AVG(({" + ".join(_rule_case(k, _MIX) for k in range(len(RULE_TREES)))}) / {len(RULE_TREES)}.0e0) AS w
          FROM x CROSS JOIN b CROSS JOIN leaf CROSS JOIN (SELECT CAST(unnest(range({1 << _M})) AS INT) AS mask) GROUP BY 1, 2),
phi AS (SELECT a.application_id, j, SUM({_WEIGHT_SQL} * (c.w - a.w)) AS phi
        FROM worth a JOIN (SELECT CAST(unnest(range({_M})) AS INT) AS j) f ON a.mask & (1 << j) = 0
        JOIN worth c ON a.application_id = c.application_id AND c.mask = a.mask + (1 << j) GROUP BY 1, 2)
SELECT application_id, CASE j {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(RULE_FEATURES))} END AS feature, ROUND(phi, 6) + 0.0e0 AS phi FROM phi"""


def _rule_parts(spark, sf_dir):
    rows = rule_rows(_split_frame(views(spark, sf_dir)))
    train = rows.where(~F.col("is_test"))
    return rows, rule_forest(train), KS.background_sample(train, "application_id", RULE_BACKGROUND)


def _long_phi(s):
    named = F.transform("phi", lambda x, i: F.struct(F.element_at(F.array(*[F.lit(f) for f in RULE_FEATURES]), i + 1).alias("feature"), (F.round(x, 6) + F.lit(0.0)).alias("phi")))
    return s.select("application_id", F.explode(named).alias("r")).select("application_id", "r.feature", "r.phi")


@register("rule_forest_shap", oracle=_RULE_SHAP_SQL, views=("risk_full",))
def rule_forest_shap(spark, sf_dir):
    """E1 by tree paths, where SQL sums over all coalitions: the same operator as ``forest_shap`` on the forest of given tests."""
    rows, forest, bg = _rule_parts(spark, sf_dir)
    columns = F.array(*RULE_FEATURES).alias("columns")
    return _long_phi(TS.tree_shap(rows.select("application_id", columns), bg.select(columns), ["application_id"], forest))


@register("rule_forest_kernel_shap", oracle=_RULE_SHAP_SQL, views=("risk_full",))
def rule_forest_kernel_shap(spark, sf_dir):
    """E1 + J11 by weighted least squares over all coalitions, the same forest and SQL."""
    rows, forest, bg = _rule_parts(spark, sf_dir)
    return _long_phi(KS.kernel_shap(rows, bg, "application_id", RULE_FEATURES, forest.output))


@register("rule_model_select", oracle=f"""
WITH {_SPLIT_FULL}, {_rule_sql()},
p AS (SELECT 0 AS model_order, 'risk_score' AS model, s.is_test, r.Approved AS y, r.probability AS p FROM risk_full r JOIN split s ON r.application_id = s.application_id
      UNION ALL SELECT 1, 'rule_forest', x.is_test, x.label, {_RULE_OUT} FROM x CROSS JOIN leaf),
t AS (SELECT * FROM p WHERE is_test),
c AS (SELECT model_order, model, COUNT(*) AS n, AVG(CASE WHEN (p >= 0.5e0) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END) AS accuracy,
             COUNT(*) FILTER (WHERE y = 1 AND p >= 0.5e0) AS tp, COUNT(*) FILTER (WHERE (y = 1) <> (p >= 0.5e0)) AS miss FROM t GROUP BY 1, 2),
d AS (SELECT model, p, SUM(y) AS pos, SUM(1 - y) AS neg FROM t GROUP BY 1, 2),
u AS (SELECT model, SUM(pos * (nc - neg + neg / 2.0e0)) / (SUM(pos) * SUM(neg)) AS auc
      FROM (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nc FROM d) q GROUP BY 1)
SELECT c.model, CAST(n AS BIGINT) AS n, ROUND(accuracy, 6) AS accuracy, ROUND(2.0e0 * tp / (2 * tp + miss), 6) AS f1, ROUND(auc, 6) AS auc,
       ROW_NUMBER() OVER (ORDER BY ROUND(auc, 9) DESC, 2.0e0 * tp / (2 * tp + miss) DESC, model_order) = 1 AS selected
FROM c JOIN u ON c.model = u.model""", views=("risk_full",))
def rule_model_select(spark, sf_dir):
    """M9-M13 with models whose predictions SQL can repeat: the metrics of both on the test split, and which one is kept."""
    v = views(spark, sf_dir)
    rows, forest, _ = _rule_parts(spark, sf_dir)
    columns = F.array(*RULE_FEATURES)
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def output(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.output(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).T))

    test = rows.where("is_test").select("application_id", "label", output(columns).alias("p"))
    risk = v.risk.select("application_id", F.col("Approved").alias("label"), F.col("probability").alias("p")).join(
        rows.where("is_test").select("application_id"), "application_id")
    found = [TR.metrics(p).withColumns({"model_order": F.lit(i), "model": F.lit(name)}) for i, (name, p) in enumerate((("risk_score", risk), ("rule_forest", test)))]
    m = found[0].unionByName(found[1]).withColumn("auc", F.round("auc", 9)).checkpoint()
    best = TR.select_best(m).select(F.col("model").alias("best"))  # one row
    return round_doubles(m.crossJoin(F.broadcast(best)).select("model", "n", "accuracy", "f1", "auc", (F.col("model") == F.col("best")).alias("selected")))

"""Queries over predictions: reports, tests, certainty, cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as s
from catalog.inputs import BASE, BASELINE, SPECIALIST, THRESHOLD, predictions
from catalog.registry import r6, register, rounded
from lexicade.functions import naming
from lexicade.operators import cascade as ca
from lexicade.operators import evaluate as ev
from lexicade.plans import tables
from lexicade.plans.corpus import split_assignments
from lexicade.sources import results
from lexicade.sources.artifacts import Store, save_best

TOKEN_RUNS = ("run_basic", "run_on_preprocessing", "run_custom")
SWEPT = ("grid_search", "run_n_grams", "run_basic", "run_custom", "run_on_preprocessing")
PREDICTED = ("model", "doc_id", "true_label", "probability")


def _of(preds, model):
    return preds.where(F.col("model") == model)


# ---------------------------------------------------------- sources, sinks ----
@register("predictions_roundtrip", s.with_(*s.predictions("run_n_grams", "grid_search")) + f"""
  SELECT experiment, model, count(*) AS n, sum(ok)::BIGINT AS n_right,
    {s.r6('avg(probability)')} AS mean_p FROM hard_labels GROUP BY experiment, model""")
def predictions_roundtrip(spark, folder):
    path = Store(spark).path("csv", folder=folder)
    results.write_predictions(predictions(spark, folder, "run_n_grams", "grid_search"), path)
    stored = results.scan_predictions(spark, path)
    right = (F.col("probability") > 0.5).cast("int") == F.col("true_label")
    return stored.groupBy("experiment", "model").agg(
        F.count("*").alias("n"), F.count_if(right).alias("n_right"),
        r6(F.avg("probability")).alias("mean_p"))


@register("predictions_scan", s.with_(*s.predictions(*TOKEN_RUNS)) + """
  SELECT experiment, model, doc_id, true_label, probability, 'Lower' AS text,
    'Custom' AS representation, 'Linear SVM' AS model_name FROM preds
  WHERE experiment = 'run_custom' AND starts_with(model, 'tokens_lower')
    AND ends_with(model, 'linear_svm') AND contains(model, 'CustomTfidf')
    AND model <> 'tokens_lower_CustomTfidf_Z4_linear_svm'""")
def predictions_scan(spark, folder):
    path = Store(spark).path("csv", folder=folder)
    results.write_predictions(predictions(spark, folder, *TOKEN_RUNS), path)
    return results.scan_predictions(
        spark, path, experiment="run_custom", prefix="tokens_lower", suffix="linear_svm",
        contains="CustomTfidf", exclude="tokens_lower_CustomTfidf_Z4_linear_svm",
        tags={"text": "Lower", "representation": "Custom", "model_name": "Linear SVM"})


def _stored_scores(spark, preds, **key):
    """Macro-F1 per run, from classification reports written and read back."""
    path = Store(spark).path("reports", **key)
    results.write_reports(ev.classification_report(preds, ["experiment", "model"]), path)
    return results.scan_reports(spark, path)


_MACRO = f"(({s.F0}) + ({s.F1})) / 2.0::DOUBLE"


@register("report_scan", s.with_(*s.predictions(*SWEPT), s.cells(by="experiment, model")) +
          f"SELECT experiment, model, {s.r6(_MACRO)} AS value FROM cells")
def report_scan(spark, folder):
    return rounded(_stored_scores(spark, predictions(spark, folder, *SWEPT), f=folder), "value")


# -------------------------------------------------------------- evaluation ----
def _report_sql() -> str:
    def weighted(m0, m1):
        return s.ratio(f"({m0}) * (tn + fp) + ({m1}) * (tp + fn)", "(tp + tn + fp + fn)")

    rows = {
        "0": (s.P0, s.R0, s.F0, "tn + fp"), "1": (s.P1, s.R1, s.F1, "tp + fn"),
        "accuracy": (s.ACC,) * 4,
        "macro avg": (f"({s.P0} + {s.P1}) / 2.0", f"({s.R0} + {s.R1}) / 2.0", _MACRO,
                      "tp + tn + fp + fn"),
        "weighted avg": (weighted(s.P0, s.P1), weighted(s.R0, s.R1), weighted(s.F0, s.F1),
                         "tp + tn + fp + fn"),
    }
    parts = [
        f"""SELECT model, {s.q(name)} AS "class", {s.r6(p)} AS precision, {s.r6(r)} AS recall,
          {s.r6(f)} AS f1_score, {s.r6(n)} AS support FROM cells"""
        for name, (p, r, f, n) in rows.items()]
    return s.with_(*s.predictions("run_basic", "cascade"), s.cells()) + " UNION ALL ".join(parts)


@register("classification_report", _report_sql())
def classification_report(spark, folder):
    report = ev.classification_report(predictions(spark, folder, "run_basic", "cascade"))
    return rounded(report, "precision", "recall", "f1_score", "support")


@register("confusion_matrix", s.with_(*s.predictions("run_basic", "cascade"), """
  grid AS (SELECT DISTINCT model, y, p FROM preds, (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(p))""",
) + f"""SELECT g.model, g.y AS true_label, g.p AS pred,
    count(h.doc_id) FILTER (WHERE h.true_label = g.y AND h.pred = g.p) AS n,
    {s.r6('avg(h.ok)')} AS accuracy
  FROM grid g JOIN hard_labels h ON h.model = g.model GROUP BY g.model, g.y, g.p""")
def confusion_matrix(spark, folder):
    return rounded(
        ev.confusion_matrix(predictions(spark, folder, "run_basic", "cascade")), "accuracy")


@register("model_metrics", s.with_(*s.predictions(), s.cells(by="experiment, model")) + f"""
  SELECT experiment, model, (tp + fp + fn + tn)::BIGINT AS n, {s.r6(s.ACC)} AS accuracy,
    {s.r6(_MACRO)} AS macro_f1 FROM cells""")
def model_metrics(spark, folder):
    scores = ev.model_metrics(predictions(spark, folder), ["experiment", "model"])
    return rounded(scores, "accuracy", "macro_f1")


_PAIRS = f"""pairs AS (SELECT c.experiment, c.model, count(*) AS n,
    count(*) FILTER (WHERE b.ok = 1 AND c.ok = 1) AS both_correct,
    count(*) FILTER (WHERE b.ok = 1 AND c.ok = 0) AS base_only,
    count(*) FILTER (WHERE b.ok = 0 AND c.ok = 1) AS comp_only,
    count(*) FILTER (WHERE b.ok = 0 AND c.ok = 0) AS both_wrong
  FROM hard_labels c JOIN hard_labels b ON b.doc_id = c.doc_id AND b.model = {s.q(BASELINE)}
  WHERE c.model <> {s.q(BASELINE)} GROUP BY c.experiment, c.model),
tests AS (SELECT *, (both_correct + comp_only)::DOUBLE / n AS acc_model,
    (both_correct + base_only)::DOUBLE / n AS acc_baseline,
    ((abs(base_only - comp_only) - 1) ** 2)::DOUBLE
      / nullif(base_only + comp_only, 0)::DOUBLE AS chi2 FROM pairs),
valued AS (SELECT *, {s.p_value('chi2')} AS p_value FROM tests)"""


@register("mcnemar", s.with_(*s.predictions(*TOKEN_RUNS), _PAIRS) + f"""SELECT experiment, model,
    {s.q(BASELINE)} AS baseline, both_correct, base_only, comp_only, both_wrong,
    {s.r6('acc_model')} AS acc_model, {s.r6('acc_baseline')} AS acc_baseline,
    {s.r6('chi2')} AS chi2, {s.r6('p_value')} AS p_value,
    CASE WHEN p_value < 0.05 AND acc_model > acc_baseline THEN 'up'
         WHEN p_value < 0.05 AND acc_model < acc_baseline THEN 'down' ELSE 'none' END AS direction
  FROM valued""")
def mcnemar(spark, folder):
    preds = predictions(spark, folder, *TOKEN_RUNS)
    tests = ev.mcnemar(preds, _of(preds, BASELINE), BASELINE)
    return rounded(tests, "acc_model", "acc_baseline", "chi2", "p_value")


@register("test_report", s.with_(*s.predictions(*TOKEN_RUNS), _PAIRS) + f"""
  SELECT experiment, regexp_extract(model, '^((?:text|tokens)_[a-z]+)', 1) AS text,
    CASE WHEN contains(model, '_CustomTfidf_') THEN 'CustomTfidf'
         WHEN contains(model, '_CustomBow_') THEN 'CustomBow'
         WHEN contains(model, '_TF-IDF_') THEN 'TF-IDF' ELSE 'BoW' END AS representation,
    model, {s.q(BASELINE)} AS baseline, {s.r6('acc_model')} AS acc_model,
    {s.r6('acc_baseline')} AS acc_baseline, {s.r6('p_value')} AS p_value FROM valued""")
def test_report(spark, folder):
    preds = predictions(spark, folder, *TOKEN_RUNS)
    tests = ev.mcnemar(preds, _of(preds, BASELINE), BASELINE)
    tagged = tests.withColumns({
        "text": naming.parse_run_name("model")["token_col"],
        "representation": naming.representation("model")})
    path = Store(spark).path("tests", folder=folder)
    results.write_tests(tagged, path)
    # the lookup holds as many runs as the sink
    lookup = results.read_p_values(spark, path).select(
        "model", "baseline", F.col("p_value").alias("found"))
    stored = results.read_tests(spark, path).join(lookup, ["model", "baseline"])
    same = F.col("found").eqNullSafe(F.col("p_value"))
    return rounded(stored.where(same).drop("found"), "acc_model", "acc_baseline", "p_value")


@register("align_predictions", s.with_(*s.predictions("run_n_grams", "bert")) + f"""
  SELECT m.experiment, m.model, m.doc_id, m.true_label, m.probability,
    b.probability AS baseline_probability
  FROM preds m JOIN preds b ON b.doc_id = m.doc_id AND b.model = {s.q(SPECIALIST)}""")
def align_predictions(spark, folder):
    preds = predictions(spark, folder, "run_n_grams", "bert")
    return ev.align(preds, _of(preds, SPECIALIST))


@register("certainty_histogram", s.with_(*s.predictions("run_n_grams", "cascade")) + """
  SELECT model, least(floor(probability * 50.0::DOUBLE)::INT + 1, 50) AS bin,
    CASE WHEN ok = 1 THEN 'Correctly Classified' WHEN pred = 0 THEN 'False Negative'
         ELSE 'False Positive' END AS outcome, count(*) AS n
  FROM hard_labels GROUP BY ALL""")
def certainty_histogram(spark, folder):
    return ev.certainty_histogram(predictions(spark, folder, "run_n_grams", "cascade"))


_BAND = """CASE WHEN probability BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE THEN 1
  WHEN probability BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE THEN 2
  WHEN probability BETWEEN 0.2::DOUBLE AND 0.8::DOUBLE THEN 3
  WHEN probability BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE THEN 4 ELSE 5 END"""


@register("certainty_bands", s.with_(*s.predictions("run_n_grams", "cascade"), f"""
  zones AS (SELECT model, {_BAND} AS band, count(*) AS predictions, sum(1 - ok) AS incorrect
    FROM hard_labels GROUP BY ALL)""") + f"""SELECT model, band,
    ['[0.4, 0.6]', '[0.3, 0.4) u (0.6, 0.7]', '[0.2, 0.3) u (0.7, 0.8]',
     '[0.1, 0.2) u (0.8, 0.9]', '[0.0, 0.1) u (0.9, 1.0]'][band] AS band_range,
    predictions, incorrect::BIGINT AS incorrect,
    {s.r6('1.0::DOUBLE - incorrect / predictions')} AS local_accuracy,
    {s.r6('predictions / sum(predictions) OVER (PARTITION BY model)')} AS workload,
    {s.r6('coalesce(incorrect / nullif(sum(incorrect) OVER (PARTITION BY model), 0), 0.0)')}
      AS error_share FROM zones""")
def certainty_bands(spark, folder):
    bands = ev.certainty_bands(predictions(spark, folder, "run_n_grams", "cascade"))
    return rounded(bands, "local_accuracy", "workload", "error_share")


@register("extreme_errors", s.with_(*s.predictions("run_n_grams", "cascade"), """
  sides AS (SELECT model, doc_id, true_label, pred, probability, 'highest' AS side,
      -probability AS o FROM hard_labels WHERE ok = 0 UNION ALL
    SELECT model, doc_id, true_label, pred, probability, 'lowest', probability
      FROM hard_labels WHERE ok = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY model, side ORDER BY o, doc_id) AS rank
    FROM sides)""") + """SELECT model, doc_id, true_label, pred, probability, side, rank
  FROM ranked WHERE rank <= 5""")
def extreme_errors(spark, folder):
    return ev.extreme_errors(predictions(spark, folder, "run_n_grams", "cascade"))


@register("uncertain_errors", s.with_(*s.predictions("run_n_grams", "cascade"), """
  ranked AS (SELECT *, abs(probability - 0.5::DOUBLE) AS u, row_number() OVER (
      PARTITION BY model ORDER BY abs(probability - 0.5::DOUBLE), doc_id) AS rank
    FROM hard_labels WHERE ok = 0)""") + f"""SELECT model, rank, doc_id, true_label, pred,
    probability, {s.r6('u')} AS uncertainty_score FROM ranked WHERE rank <= 10""")
def uncertain_errors(spark, folder):
    errors = ev.uncertain_errors(predictions(spark, folder, "run_n_grams", "cascade"))
    return rounded(errors, "uncertainty_score")


# ----------------------------------------------------------------- cascade ----
_K = "try_cast(regexp_extract(model, '(?:^|_)k(\\d+)(?:_|$)', 1) AS INT)"
_W = "try_cast(regexp_extract(model, '(?:^|_)w(\\d+(?:[.]\\d+)?)(?:_|$)', 1) AS DOUBLE)"
_ZP = "try_cast(regexp_extract(model, '(?:^|_)z(\\d+(?:[.]\\d+)?)(?:_|$)', 1) AS DOUBLE)"
_ZALL = _ZP.replace(")z(", ")[zZ](")


def _c(x: str) -> str:
    """Of the curve's column, where the result has one of the same name."""
    return x.replace("(model,", "(curve.model,")


_NG = "nullif(regexp_extract(model, '(?:^|_)ng(\\d+-\\d+)(?:_|$)', 1), '')"
_HARD = f"probability >= {THRESHOLD}::DOUBLE AND probability <= 1.0::DOUBLE - {THRESHOLD}::DOUBLE"


def _split_base(spark, folder):
    splits = split_assignments(spark, folder, Store(spark)).select("doc_id", "split")
    return predictions(spark, folder, "cascade").join(
        splits.hint("shuffle_hash"), "doc_id").where(
        (F.col("model") == BASE) & (F.col("split") != "test"))


_BASE_SPLIT = (*s.predictions("cascade"), s.UNIQUE, s.SPLIT, f"""base AS (
  SELECT p.*, split FROM preds p JOIN split USING (doc_id)
  WHERE model = {s.q(BASE)} AND split <> 'test')""")


@register("hard_samples", s.with_(*_BASE_SPLIT) +
          f"SELECT split, doc_id, probability FROM base WHERE {_HARD}")
def hard_samples(spark, folder):
    store = Store(spark)
    hard = ca.hard_samples(_split_base(spark, folder), THRESHOLD)
    return store.table(lambda: hard.select("split", "doc_id", "probability"), "hard", f=folder)


@register("hard_rates", s.with_(*_BASE_SPLIT) + f"""SELECT split, count(*) AS n,
  count(*) FILTER (WHERE {_HARD}) AS n_hard,
  {s.r6(f'count(*) FILTER (WHERE {_HARD}) / count(*)')} AS rate FROM base GROUP BY split""")
def hard_rates(spark, folder):
    return rounded(ca.hard_rates(_split_base(spark, folder), THRESHOLD), "rate")


_SPECIALISTS = "('SVM_Specialist', 'BERT_Basic', 'BERT_Specialist')"
_MERGED = f"""merged AS (SELECT CASE p.model WHEN 'SVM_Specialist' THEN 'SVM_Spec_Cascade'
      WHEN 'BERT_Specialist' THEN 'BERT_Spec_Cascade' ELSE 'BERT_Basic_Cascade' END AS model, b.doc_id, b.true_label,
    CASE WHEN b.{_HARD.replace(' AND ', ' AND b.')} THEN p.probability
         ELSE b.probability END AS probability,
    (b.{_HARD.replace(' AND ', ' AND b.')}) AS delegated
  FROM preds b JOIN preds p USING (doc_id)
  WHERE b.model = {s.q(BASE)} AND p.model IN {_SPECIALISTS})"""


def _cascades(preds):
    chosen = preds.where(F.col("model").isin("SVM_Specialist", "BERT_Basic", "BERT_Specialist"))
    return ca.cascade_merge(_of(preds, BASE), chosen, THRESHOLD)


@register("cascade_merge", s.with_(*s.predictions("cascade"), _MERGED) + "SELECT * FROM merged")
def cascade_merge(spark, folder):
    return _cascades(predictions(spark, folder, "cascade"))


_MERGED_OK = """merged_ok AS (SELECT *, (probability > 0.5)::INT AS pred FROM merged)"""


@register("cascade_apply", s.with_(
    *s.predictions("cascade"), _MERGED, _MERGED_OK, s.cells("merged_ok")) +
    _report_sql().split(s.cells())[1].lstrip("\n"))
def cascade_apply(spark, folder):
    store = Store(spark)
    merged = _cascades(predictions(spark, folder, "cascade")).withColumn(
        "experiment", F.lit("cascade"))
    path = store.path("csv", folder=folder)
    results.write_predictions(merged, path)
    report = ev.classification_report(results.scan_predictions(spark, path, "cascade"))
    return rounded(report, "precision", "recall", "f1_score", "support")


@register("hard_subset_metrics", s.with_(*s.predictions("cascade"), f"""
  chosen AS (SELECT h.* FROM hard_labels h WHERE doc_id IN (
    SELECT doc_id FROM preds WHERE model = {s.q(BASE)} AND {_HARD}))""", s.cells("chosen")) +
    f"""SELECT model, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
      {s.r6(s.ACC)} AS accuracy FROM cells""")
def hard_subset_metrics(spark, folder):
    preds = predictions(spark, folder, "cascade")
    return rounded(ca.hard_subset_metrics(preds, _of(preds, BASE), THRESHOLD), "accuracy")


_CURVE = f"""steps AS (SELECT i, CASE WHEN i = 199 THEN 1.0::DOUBLE
    ELSE 0.5::DOUBLE + i * (0.5::DOUBLE / 199) END AS c FROM range(200) t(i)),
spec AS (SELECT doc_id, ok AS spec_ok FROM hard_labels WHERE model = {s.q(SPECIALIST)}),
tested AS (SELECT experiment, model, c, ok, spec_ok,
    (c < 1.0 AND (probability >= c OR probability <= 1.0::DOUBLE - c))::INT AS certain
  FROM hard_labels JOIN spec USING (doc_id), steps WHERE model <> {s.q(SPECIALIST)}),
curve AS MATERIALIZED (SELECT experiment, model, c AS certainty_threshold, avg(certain) AS coverage,
    1.0::DOUBLE - avg(certain) AS delegated,
    coalesce(sum(ok * certain) / nullif(sum(certain), 0), 1.0::DOUBLE) AS local_accuracy,
    (sum(ok * certain) + sum(spec_ok * (1 - certain)))::DOUBLE / count(*) AS hybrid_accuracy
  FROM tested GROUP BY experiment, model, c)"""
_RATES = ("coverage", "delegated", "local_accuracy", "hybrid_accuracy")
_CURVE_COLUMNS = "experiment, model, " + ", ".join(
    f"{s.r6(c)} AS {c}" for c in ("certainty_threshold", *_RATES))


def _curve(spark, folder):
    preds = predictions(spark, folder, *SWEPT, "bert")
    spec = _of(preds, SPECIALIST)
    return ca.cascade_sweep(preds.where(F.col("model") != SPECIALIST), spec), spec


@register("cascade_sweep", s.with_(*s.predictions(*SWEPT, "bert"), _CURVE) +
          f"SELECT {_CURVE_COLUMNS} FROM curve")
def cascade_sweep(spark, folder):
    return rounded(_curve(spark, folder)[0], "certainty_threshold", *_RATES)


@register("top_models", s.with_(*s.predictions(*SWEPT, "bert"), _CURVE) + f"""
  SELECT {_CURVE_COLUMNS} FROM curve WHERE (experiment, model) IN (SELECT (experiment, model)
    FROM curve WHERE contains(lower(model), 'svm') GROUP BY experiment, model
    ORDER BY max(round(hybrid_accuracy, 9)) DESC, model, experiment LIMIT 4)""")
def top_models(spark, folder):
    curve = Store(spark).table(lambda: _curve(spark, folder)[0].withColumn(
        "hybrid_accuracy", F.round("hybrid_accuracy", 9)), "curve", folder=folder)
    return rounded(ca.top_models(curve, "svm"), "certainty_threshold", *_RATES)


@register("cascade_best", s.with_(*s.predictions(*SWEPT, "bert"), _CURVE) + f"""
  SELECT curve.model AS winner, {s.r6('certainty_threshold')} AS certainty_threshold,
    round(1.0::DOUBLE - certainty_threshold, 3) AS delegation_threshold,
    {s.r6('hybrid_accuracy')} AS hybrid_accuracy, {s.r6('delegated')} AS delegated,
    {s.r6('hybrid_accuracy - (SELECT avg(spec_ok) FROM spec)')} AS gain,
    CASE WHEN contains(lower(curve.model), 'svm') THEN 'linear_svm' ELSE 'logreg' END AS model,
    coalesce(nullif(regexp_extract(curve.model, '(text|tokens)_[a-z]+'), ''), 'tokens_lower')
      AS token_col,
    list_transform(string_split(coalesce({_c(_NG)}, '1-3'), '-'), lambda x: x::INT) AS ngram_range,
    coalesce({_c(_K)}, 0) AS n_concepts, coalesce({_c(_ZALL)}, 2.0::DOUBLE) AS z_threshold,
    coalesce({_c(_K)}, 0) > 0 AS use_concepts, coalesce({_c(_W)}, 0.0::DOUBLE) AS polarity_weight
  FROM curve ORDER BY round(curve.hybrid_accuracy, 9) DESC, curve.model,
    curve.certainty_threshold, experiment
  LIMIT 1""")
def cascade_best(spark, folder):
    curve, spec = _curve(spark, folder)
    best = ca.best_configuration(
        curve.withColumn("hybrid_accuracy", F.round("hybrid_accuracy", 9)), spec)
    path = Store(spark).path("best", folder=folder)
    save_best(best, path)
    stored = spark.read.schema(best.schema).json(path)
    return stored.select(
        "winner", r6("certainty_threshold").alias("certainty_threshold"),
        F.col("cascade.delegation_threshold").alias("delegation_threshold"),
        r6("hybrid_accuracy").alias("hybrid_accuracy"), r6("delegated").alias("delegated"),
        r6("gain").alias("gain"), "model", "features.*")


# ------------------------------------------------------------ result tables ----


@register("param_study", s.with_(*s.predictions("params", "grid_search", "bert"), f"""
  runs2 AS (SELECT CASE WHEN contains(model, 'linear_svm') THEN 'SVM' ELSE 'LogReg' END AS m,
      {_NG} AS n_grams, {_ZP} AS z_score, {_K} AS k_val, {_W} AS w_val, avg(ok) AS acc
    FROM hard_labels WHERE model <> {s.q(SPECIALIST)} GROUP BY model)""") + f"""
  SELECT m AS model, n_grams, z_score, k_val, w_val, {s.r6('acc')} AS accuracy,
    CASE WHEN w_val > 0 THEN 'w=' || w_val::INT ELSE 'w=0' END AS w_label,
    m || '_' || n_grams || '_w' || w_val AS config_id FROM runs2
  WHERE n_grams IS NOT NULL AND z_score IS NOT NULL AND k_val IS NOT NULL
    AND w_val IS NOT NULL""")
def param_study(spark, folder):
    preds = predictions(spark, folder, "params", "grid_search", "bert")
    return rounded(tables.parameter_study(preds), "accuracy")


BASELINES = tuple(
    f"text_expanded_lower_{r}_{m}" for r in ("BoW", "TF-IDF") for m in ("linear_svm", "logreg"))


def _ablation_sql() -> str:
    names = "CASE t " + " ".join(
        f"WHEN {s.q(k)} THEN {s.q(v)}" for k, v in tables.naming.TOKEN_DISPLAY.items()) + " END"
    name = ("regexp_extract(model, '^(tokens_[a-z]+)_(BoW|TF-IDF|CustomBow_Z2|CustomTfidf_Z2)"
            "_(linear_svm|logreg)$', {})")
    return s.with_(*s.predictions(*TOKEN_RUNS), s.cells(), f"""
      f1s AS (SELECT model, {s.r6(_MACRO)} AS f FROM cells),
      parsed AS (SELECT model AS run, f, {name.format(1)} AS t,
        replace({name.format(2)}, '_Z2', '') AS rep, {name.format(3)} AS m FROM f1s
        WHERE {name.format(1)} <> ''),
      based AS (SELECT *, 'text_expanded_lower_' || CASE WHEN rep IN ('BoW', 'CustomBow')
        THEN 'BoW' ELSE 'TF-IDF' END || '_' || m AS baseline FROM parsed),
      tested AS (SELECT run, count(*) FILTER (WHERE y.ok = 1 AND x.ok = 0) AS lost,
          count(*) FILTER (WHERE y.ok = 0 AND x.ok = 1) AS won
        FROM based JOIN hard_labels x ON x.model = run
          JOIN hard_labels y ON y.model = baseline AND y.doc_id = x.doc_id GROUP BY run),
      valued AS (SELECT run, {s.p_value(
          '(((abs(lost - won) - 1) ** 2)::DOUBLE / nullif(lost + won, 0)::DOUBLE)')} AS p_value
        FROM tested)""") + f"""
      SELECT {names} AS token_processing, rep AS representation,
        CASE m WHEN 'logreg' THEN 'Logistic Regression' ELSE 'Linear SVM' END AS model, b.run,
        b.f AS macro_f1, b.baseline, x.f AS baseline_f1, {s.r6('v.p_value')} AS p_value,
        coalesce(round(v.p_value, 6) >= 0.05, false) AS insignificant,
        (row_number() OVER (PARTITION BY m ORDER BY b.f DESC, b.run) = 1) AS best
      FROM based b LEFT JOIN f1s x ON x.model = b.baseline LEFT JOIN valued v ON v.run = b.run"""


@register("ablation_table", _ablation_sql())
def ablation_table(spark, folder):
    preds = Store(spark).table(lambda: predictions(spark, folder, *TOKEN_RUNS), "preds", f=folder)
    scores = rounded(_stored_scores(spark, preds, f=folder), "value").drop("experiment")
    tests = rounded(ev.mcnemar_matched(preds, BASELINES), "p_value")
    return tables.ablation_table(scores, tests)


@register("concept_comparison", s.with_(*s.predictions("grid_search"), s.cells(), f"""
  f1s AS (SELECT model, {s.r6(_MACRO)} AS f, {_K} AS k, {_W} AS w,
    regexp_extract(model, '^(linear_svm|logreg)', 1) AS m FROM cells)""") + f"""
  SELECT CASE a.m WHEN 'logreg' THEN 'Logistic Regression' ELSE 'Linear SVM' END AS model,
    a.model AS run, a.k, 'w=' || a.w::INT AS weight, a.f AS macro_f1, b.f AS baseline_f1,
    {s.r6('a.f - b.f')} AS gain
  FROM f1s a LEFT JOIN f1s b ON b.m = a.m AND b.k = 0 AND b.w = 0 WHERE a.k > 0""")
def concept_comparison(spark, folder):
    scores = _stored_scores(spark, predictions(spark, folder, "grid_search"), f=folder)
    return rounded(tables.concept_comparison(rounded(scores, "value")), "gain")


@register("pruning_tolerance", s.with_(*s.predictions("run_custom"), f"""
  rows2 AS (SELECT regexp_extract(model, '^(tokens_[a-z]+)_', 1) AS token_col,
      regexp_extract(model, '_(CustomBow|CustomTfidf)_', 1) AS representation,
      regexp_extract(model, '(linear_svm|logreg)$', 1) AS classifier,
      regexp_extract(model, '_Z(\\d)_', 1)::DOUBLE AS z, doc_id, true_label, pred, ok
    FROM hard_labels)""",
    s.cells("rows2", "token_col, representation, classifier, z"), f"""
  f1s AS (SELECT *, {_MACRO} AS f FROM cells),
  cmp AS (SELECT c.token_col, c.representation, c.classifier, c.z, avg(c.ok) AS am,
      avg(b.ok) AS ab, count(*) FILTER (WHERE b.ok = 1 AND c.ok = 0) AS bo,
      count(*) FILTER (WHERE b.ok = 0 AND c.ok = 1) AS co
    FROM rows2 c JOIN rows2 b USING (token_col, representation, classifier, doc_id)
    WHERE b.z = 0 GROUP BY ALL),
  worse AS (SELECT *, coalesce(am < ab AND
      {s.p_value('(((abs(bo - co) - 1) ** 2)::DOUBLE / nullif(bo + co, 0)::DOUBLE)')} < 0.05,
      false) AS down FROM cmp)""") + f"""
  SELECT token_col, representation, classifier,
    max(CASE WHEN rn = 1 THEN z END) AS best_z, {s.r6('max(f)')} AS best_macro_f1,
    max(CASE WHEN NOT down THEN z END) AS tolerated_z
  FROM (SELECT f1s.*, down, row_number() OVER (
      PARTITION BY token_col, representation, classifier ORDER BY round(f, 9) DESC, z) AS rn
    FROM f1s JOIN worse USING (token_col, representation, classifier, z))
  GROUP BY token_col, representation, classifier""")
def pruning_tolerance(spark, folder):
    return rounded(
        tables.pruning_tolerance(predictions(spark, folder, "run_custom")), "best_macro_f1")


@register("cascade_significance", s.with_(*s.predictions("cascade"), _MERGED, f"""
  every AS (SELECT model, doc_id, true_label, probability FROM merged UNION ALL
    SELECT model, doc_id, true_label, probability FROM preds
    WHERE model IN ('BERT_Basic', {s.q(BASE)})),
  every_ok AS (SELECT *, (probability > 0.5)::INT AS pred,
    ((probability > 0.5)::INT = true_label)::INT AS ok FROM every)""",
    s.cells("every_ok"), f"""
  cmp AS (SELECT c.model, avg(c.ok) AS am, avg(b.ok) AS ab,
      count(*) FILTER (WHERE b.ok = 1 AND c.ok = 0) AS bo,
      count(*) FILTER (WHERE b.ok = 0 AND c.ok = 1) AS co
    FROM every_ok c JOIN every_ok b USING (doc_id)
    WHERE b.model = {s.q(BASE)} AND c.model <> {s.q(BASE)} GROUP BY c.model),
  valued AS (SELECT *,
    {s.p_value('(((abs(bo - co) - 1) ** 2)::DOUBLE / nullif(bo + co, 0)::DOUBLE)')} AS p
    FROM cmp)""") + f"""
  SELECT model, CASE model WHEN 'BERT_Basic_Cascade' THEN 'Base + Basic BERT'
      WHEN 'BERT_Spec_Cascade' THEN 'Base + Spec. BERT'
      WHEN 'SVM_Spec_Cascade' THEN 'Base + Spec. SVM'
      WHEN 'BERT_Basic' THEN 'BERT Basic' END AS label,
    {s.r6(_MACRO)} AS macro_f1, {s.r6('p')} AS p_value,
    CASE WHEN p < 0.05 AND am > ab THEN 'up' WHEN p < 0.05 AND am < ab THEN 'down'
         ELSE 'none' END AS direction,
    (row_number() OVER (ORDER BY round({_MACRO}, 6) DESC, model) = 1) AS best
  FROM cells JOIN valued USING (model)""")
def cascade_significance(spark, folder):
    store = Store(spark)
    preds = predictions(spark, folder, "cascade").select(*PREDICTED)
    merged = store.table(lambda: _cascades(preds).select(*PREDICTED), "cascades", f=folder)
    single = store.table(lambda: _of(preds, "BERT_Basic"), "single", f=folder)
    every = merged.unionByName(single)
    tests = ev.mcnemar(every, _of(preds, BASE), BASE, by=["model"])
    scores = rounded(ev.model_metrics(every), "macro_f1")
    return rounded(tables.cascade_significance(tests, scores), "p_value")

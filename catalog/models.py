"""Queries that train and apply models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as s
from catalog.features import sweep_sql
from catalog.registry import register, rounded
from lexicade.functions.text import clean_text
from lexicade.operators import linear
from lexicade.operators import models as mo
from lexicade.operators.evaluate import model_metrics
from lexicade.operators.scoring import keep_features, score_documents
from lexicade.plans import evaluate as ev
from lexicade.plans import experiments as ex
from lexicade.plans import representation as rp
from lexicade.plans.corpus import split_corpus
from lexicade.sources.artifacts import Store

HARD = 0.05


def _vectors(spark, folder, weighting="tfidf", z=2.0):
    rep = rp.load_representation(spark, rp.Source(folder), Store(spark), z=z)
    return rp.vectors(rep, weighting)


def _checked(preds, *more):
    """Facts about predictions that hold for any fitted model."""
    p = F.col("probability")
    return preds.select("model", "split", "doc_id", "true_label", ((p > 0) & (p < 1)).alias("proper"), *more)


def _fit_terms(spark, train, model):
    """Weights by part, cells, and every row's (part, held, y, score), by joins from a model's numbers."""
    svm = model.spec.kind == "linear_svm"
    rows = mo.matrix_rows(train, "m", mo.fold_of(train) if svm else None).select("doc_id", "label", "fold", "idx", "cnt")
    parts = spark.createDataFrame(
        [(i, p.fold, float(p.intercept), p.slope, p.shift) for i, p in enumerate(model.parts)],
        "part int, held int, intercept double, slope double, shift double")
    weights = spark.createDataFrame(
        [(i, int(j), float(w)) for i, p in enumerate(model.parts) for j, w in zip(model.spec.columns, p.weights)],
        "part int, idx int, w double")
    cells = rows.select("doc_id", F.explode(F.arrays_zip("idx", "cnt")).alias("c")).select("doc_id", "c.idx", "c.cnt")
    dots = cells.join(weights, "idx").groupBy("part", "doc_id").agg(F.sum(F.col("w") * F.col("cnt")).alias("dot"))
    y = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    each = rows.select("doc_id", "fold", y.alias("y"), F.explode(
        F.sequence(F.lit(0), F.lit(len(model.parts) - 1))).alias("part")).join(F.broadcast(parts), "part")
    scored = each.join(dots, ["part", "doc_id"], "left").withColumn(
        "score", F.coalesce("dot", F.lit(0.0)) + F.col("intercept"))
    return weights, cells, scored


def _gradient_norms(weights, cells, scored, svm):
    """(part, norm) of the gradient, straight from the stated objective."""
    margin = F.col("y") * F.col("score")
    slope = -2.0 * F.col("y") * F.greatest(F.lit(0.0), 1.0 - margin) if svm else -F.col("y") / (1.0 + F.exp(margin))
    slopes = scored.where("fold <> held").select("part", "intercept", "doc_id", slope.alias("r"))
    sums = cells.join(slopes, "doc_id").groupBy("part", "idx").agg(F.sum(F.col("r") * F.col("cnt")).alias("s"))
    by_weight = weights.join(sums, ["part", "idx"], "left").groupBy("part").agg(
        F.sum(F.pow(F.col("w") + F.coalesce("s", F.lit(0.0)), 2)).alias("g"))
    by_row = slopes.groupBy("part", "intercept").agg(F.sum("r").alias("s"))
    inside = F.col("intercept") if svm else F.lit(0.0)
    return by_weight.join(by_row, "part").select("part", F.sqrt(F.col("g") + F.pow(F.col("s") + inside, 2)).alias("norm"))


def _calibration_gaps(scored):
    """(part, gap): the gradient of the sigmoid's loss on the fold left out, per row of it."""
    held = scored.where("fold = held")
    one = F.col("y") > 0
    sizes = held.groupBy("part").agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n0"))
    target = F.when(one, (F.col("n1") + 1) / (F.col("n1") + 2)).otherwise(1 / (F.col("n0") + 2))
    p = 1.0 / (1.0 + F.exp(-(F.col("slope") * F.col("score") + F.col("shift"))))
    e = held.join(F.broadcast(sizes), "part").select("part", "score", (p - target).alias("e"))
    return e.groupBy("part").agg(F.greatest(
        F.abs(F.avg("e")), F.abs(F.avg(F.col("e") * F.col("score")))).alias("gap"))


def _fit_and_score(spark, folder, kind):
    """With facts of the fit: its gradient is zero, and so is that of every calibration."""
    data = _vectors(spark, folder)
    train = data.where("split = 'train'")
    model = mo.fit_model(kind, train)
    svm = kind == "linear_svm"
    terms = _fit_terms(spark, train, model)
    norm = _gradient_norms(*terms, svm).agg(F.max("norm"), F.count("*")).first()
    facts = [F.lit(norm[0] <= 1.01 * linear.TOL and norm[1] == len(model.parts)).alias("flat")]
    if svm:
        gap = _calibration_gaps(terms[2]).agg(F.max("gap"), F.count("*")).first()
        facts.append(F.lit(gap[0] < 1e-6 and gap[1] == len(model.parts)).alias("calibrated"))
    return _checked(mo.predict(model, data.where("split = 'val'"), kind), *facts)


def _facts(name, split, *more):
    """SQL of ``_checked``; ``more`` are names of facts that must hold."""
    true = "".join(f", true AS {m}" for m in more)
    return s.with_(*s.split_corpus()) + f"""SELECT {s.q(name)} AS model, split, doc_id,
      label AS true_label, true AS proper{true} FROM split WHERE split = {s.q(split)}"""


@register("svm_calibrated", _facts("linear_svm", "val", "flat", "calibrated"))
def svm_calibrated(spark, folder):
    return _fit_and_score(spark, folder, "linear_svm")


@register("logreg", _facts("logreg", "val", "flat"))
def logreg(spark, folder):
    return _fit_and_score(spark, folder, "logreg")


@register("model_roundtrip", s.with_(*s.split_corpus()) + """SELECT count(*) AS n,
  0.0::DOUBLE AS gap FROM split WHERE split = 'test'""")
def model_roundtrip(spark, folder):
    """Largest difference between a model's predictions and its stored copy's."""
    data = _vectors(spark, folder)
    model = mo.fit_model("logreg", data.where("split = 'train'"))
    path = Store(spark).path("model", folder=folder)
    mo.save_model(spark, model, path)
    held = data.where("split = 'test'")
    before = mo.predict(model, held, "before").select("doc_id", F.col("probability").alias("p"))
    after = mo.predict(mo.load_model(spark, path), held, "after")
    return after.join(before, "doc_id").agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("p") - F.col("probability"))).alias("gap"))


@register("specialist_svm", _facts("SVM_Specialist", "test", "same_hard"))
def specialist_svm(spark, folder):
    """Scores of the stored specialist; its stored hard rows are those the stored base is unsure of."""
    path = Store(spark).path("specialist", folder=folder)
    vectors = _vectors(spark, folder)
    mo.save_specialist(spark, mo.train_specialist(vectors, HARD), path)
    parts = mo.load_specialist(spark, path)
    again = mo.predict(parts["base"], vectors.where("split <> 'test'"), "base")
    unsure = again.where((F.col("probability") >= HARD) & (F.col("probability") <= 1 - HARD)).select("split", "doc_id")
    hard = parts["hard"].select("split", "doc_id")
    same = unsure.exceptAll(hard).isEmpty() and hard.exceptAll(unsure).isEmpty() and not hard.isEmpty()
    scored = mo.predict(parts["specialist"], vectors.where("split = 'test'"), "SVM_Specialist")
    return _checked(scored, F.lit(same).alias("same_hard"))


def _report_rows(source):
    macro = f"(({s.F0}) + ({s.F1})) / 2.0::DOUBLE"
    rows = {"0": (s.P0, s.R0, s.F0, "tn + fp"), "1": (s.P1, s.R1, s.F1, "tp + fn"), "accuracy": (s.ACC,) * 4,
            "macro avg": (f"({s.P0} + {s.P1}) / 2.0", f"({s.R0} + {s.R1}) / 2.0", macro, "tp + tn + fp + fn")}
    return " UNION ALL ".join(
        f"""SELECT model, {s.q(name)} AS "class", {s.r6(p)} AS precision, {s.r6(r)} AS recall, {s.r6(f)} AS f1_score,
          {s.r6(n)} AS support FROM {source}""" for name, (p, r, f, n) in rows.items())


_BY_Z = """means AS (SELECT doc_id, sum(cnt * z) / sum(cnt) AS m FROM cnts JOIN z USING (term) WHERE abs(z) > 2 GROUP BY doc_id),
preds AS (SELECT 'zscore' AS model, split, doc_id, label::INT AS true_label,
  round(1.0::DOUBLE / (1.0::DOUBLE + exp(-coalesce(m, 0.0::DOUBLE))), 6) AS probability FROM split LEFT JOIN means USING (doc_id))"""


def _by_z(spark, folder):
    src, store = rp.Source(folder), Store(spark)
    units = rp.unit_features(spark, src, store)
    kept = store.table(lambda: keep_features(units, 2.0), "kept", **src.key())
    docs = rp.assignments(spark, src, store)
    return score_documents(docs, rp.unit_matrix(spark, src, store), kept, "zscore", units)


@register("score_by_z", s.with_(*s.z_features(), _BY_Z) + "SELECT model, split, doc_id, true_label, probability FROM preds")
def score_by_z(spark, folder):
    """Every document scored by the mean z of its kept n-grams."""
    return _by_z(spark, folder)


@register("evaluate_split", s.with_(
    *s.z_features(), _BY_Z, "held AS (SELECT *, (probability > 0.5)::INT AS pred FROM preds WHERE split = 'val')",
    s.cells("held")) + _report_rows("cells"))
def evaluate_split(spark, folder):
    """The validation report of the z scorer, by way of stored predictions and a stored report."""
    held = _by_z(spark, folder).where("split = 'val'")
    _, report = ev.evaluate(spark, held, Store(spark).path("results", folder=folder), "zscore")
    return rounded(report.where("class <> 'weighted avg'").select(
        "model", "class", "precision", "recall", "f1_score", "support"), "precision", "recall", "f1_score", "support")


@register("evaluate_model", s.with_(*s.split_corpus()) + """SELECT 'logreg' AS model, 'val' AS split, count(*) AS n,
  count(*) FILTER (WHERE label = 1) AS n_pos, true AS same FROM split WHERE split = 'val'""")
def evaluate_model(spark, folder):
    """A fitted model evaluated on the validation split: the stored report is that of the stored predictions."""
    data = _vectors(spark, folder)
    model = mo.fit_model("logreg", data.where("split = 'train'"))
    preds, report = ev.evaluate_model(model, data, "val", Store(spark).path("results", folder=folder), "single", "logreg")
    right = F.col("true_label") == (F.col("probability") > 0.5).cast("int")
    facts = preds.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("true_label") == 1).alias("n_pos"), F.avg(right.cast("double")).alias("a"))
    accuracy = report.where("class = 'accuracy'").select("model", "precision")
    return facts.join(accuracy, "model").select(
        "model", F.lit("val").alias("split"), "n", "n_pos", (F.abs(F.col("a") - F.col("precision")) < 1e-6).alias("same"))


def make_scorer():
    """A model from outside: share of capital letters among letters, squashed."""
    import numpy as np

    def score(texts):
        out = [
            sum(c.isupper() for c in t) / max(1, sum(c.isalpha() for c in t))
            for t in map(str, texts)
        ]
        return 1.0 / (1.0 + np.exp(-20.0 * (np.array(out, dtype=np.float64) - 0.03)))

    return score


@register("external_specialist", s.with_(*s.split_corpus()) + f"""SELECT 'external' AS model, split,
  doc_id, label AS true_label, {s.r6("""1.0::DOUBLE / (1.0::DOUBLE + exp(-20.0::DOUBLE * (
    len(regexp_extract_all(t, '[\\p{Lu}]'))::DOUBLE
      / greatest(1, len(regexp_extract_all(t, '[\\p{L}]'))) - 0.03::DOUBLE)))""")} AS probability
  FROM (SELECT *, {s.clean('text')} AS t FROM split)""")
def external_specialist(spark, folder):
    docs = split_corpus(spark, folder, Store(spark)).withColumn("text_clean", clean_text("text"))
    return rounded(mo.score_text(docs, make_scorer, "external"), "probability")


def _series(spark, folder, specs):
    """Every run of a series: scored documents, a proper accuracy, or why it has none."""
    preds, failed = ex.run_experiments(spark, specs, Store(spark))
    every = spark.createDataFrame(
        [(x.experiment, x.name, failed.get(x.name)) for x in specs],
        "experiment string, model string, reason string")
    if preds is None:
        raise RuntimeError(f"no run succeeded: {failed}")
    scores = model_metrics(preds, ["experiment", "model", "elapsed_s", "gradient"])
    few = F.col("reason") == "fewer than two features"
    return every.join(scores, ["experiment", "model"], "left").select(
        "experiment", "model",
        F.when(F.col("n").isNotNull(), "done").when(few, "too few").otherwise(F.col("reason")).alias("status"),
        "n", (F.col("accuracy").between(0, 1) & (F.col("elapsed_s") > 0)
              & (F.col("gradient") <= linear.TOL)).alias("proper"))


def _series_sql(specs, kept=None):
    """``kept``: SQL of (token_col, threshold, kept) for runs that may have too few features."""
    runs = ", ".join(f"({s.q(x.experiment)}, {s.q(x.name)}, {s.q(x.source.token_col)}, "
                     f"{'NULL' if x.z is None else x.z}::DOUBLE)" for x in specs)
    kept = kept or "SELECT NULL::VARCHAR AS token_col, NULL::DOUBLE AS threshold, NULL::BIGINT AS kept"
    return s.with_(*s.split_corpus(), f"runs(experiment, model, token_col, z) AS (VALUES {runs})",
                   f"sizes AS ({kept})", """
      rated AS (SELECT runs.*, coalesce(kept, 2) >= 2 AS enough FROM runs LEFT JOIN sizes
        ON sizes.token_col = runs.token_col AND threshold = z)""") + """
      SELECT experiment, model, CASE WHEN enough THEN 'done' ELSE 'too few' END AS status,
        CASE WHEN enough THEN (SELECT count(*) FROM split WHERE split = 'val') END AS n,
        CASE WHEN enough THEN true END AS proper FROM rated"""


SERIES = {
    "exp_basic": ex.basic_specs, "exp_tokens": ex.token_specs, "exp_pruning": ex.pruning_specs,
    "exp_ngrams": ex.ngram_specs, "exp_grid": ex.grid_specs,
}
for _name, _specs in SERIES.items():
    _kept = sweep_sql() if _name == "exp_pruning" else None
    register(_name, _series_sql(_specs(rp.Source("")), _kept))(
        lambda spark, folder, specs=_specs: _series(spark, folder, specs(rp.Source(folder))))

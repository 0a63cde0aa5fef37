"""Experiment series: many specifications, fitted together, one table of predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicade.operators import linear
from lexicade.operators.concepts import SEED
from lexicade.operators.joins import join_per_key
from lexicade.operators.models import MODELS, feature_structs, fold_of, matrix_rows
from lexicade.operators.ranking import sorted_index
from lexicade.plans.representation import (
    Source, assignments, concept_key, concept_matrix, encoder_key, train_size, unit_features, unit_matrix,
)
from lexicade.sources.artifacts import Store
from lexicade.sources.corpus import TOKEN_COLUMNS

# --- fixed values: the grids of the documented series -------------------------
NGRAM_RANGES = ((1, 1), (1, 2), (1, 3))
Z_THRESHOLDS = (0, 1, 2, 3, 4)
N_CONCEPTS = (0, 500, 5000, 10000)
WEIGHTS = (0.0, 1.0, 10.0)
PARALLELISM = 4  # matrices built at a time


@dataclass(frozen=True)
class Spec:
    """One configuration: features, weighting and model."""

    experiment: str
    name: str
    source: Source
    model: str
    weighting: str = "tfidf"
    z: float | None = None
    k: int = 0
    w: float = 0.0


def basic_specs(src: Source, models: Sequence[str] = MODELS,
                texts: Sequence[str] = ("text_clean", "text_expanded"),
                cases: Sequence[str] = ("lower", "cased")) -> list[Spec]:
    """Text variant x casing x weighting x model, default word tokeniser, no pruning."""
    return [
        Spec("run_basic", f"{text}_{case}_{rep}_{m}",
             replace(src, token_col=f"words:{text}:{case}"), m, weighting)
        for text, case in product(texts, cases)
        for rep, weighting in (("BoW", "bow"), ("TF-IDF", "tfidf"))
        for m in models
    ]


def token_specs(src: Source, models: Sequence[str] = MODELS,
                columns: Sequence[str] = TOKEN_COLUMNS) -> list[Spec]:
    """Token column x weighting x model, no pruning."""
    return [
        Spec("run_on_preprocessing", f"{col}_{rep}_{m}", replace(src, token_col=col), m, weighting)
        for col in columns
        for rep, weighting in (("BoW", "bow"), ("TF-IDF", "tfidf"))
        for m in models
    ]


def pruning_specs(src: Source, models: Sequence[str] = MODELS,
                  columns: Sequence[str] = TOKEN_COLUMNS,
                  thresholds: Sequence[float] = Z_THRESHOLDS) -> list[Spec]:
    """Token column x z threshold x weighting x model."""
    return [
        Spec("run_custom", f"{col}_{rep}_Z{z:g}_{m}", replace(src, token_col=col), m, weighting,
             float(z))
        for col, z in product(columns, thresholds)
        for rep, weighting in (("CustomBow", "bow"), ("CustomTfidf", "tfidf"))
        for m in models
    ]


def ngram_specs(src: Source, models: Sequence[str] = MODELS,
                ranges: Sequence[tuple[int, int]] = NGRAM_RANGES) -> list[Spec]:
    """N-gram range x model, pruned at z = 2."""
    return [
        Spec("run_n_grams", f"ng{lo}-{hi}_{m}", replace(src, n_range=(lo, hi)), m, "tfidf", 2.0)
        for lo, hi in ranges for m in models
    ]


def grid_specs(src: Source, models: Sequence[str] = MODELS,
               n_concepts: Sequence[int] = N_CONCEPTS,
               weights: Sequence[float] = WEIGHTS) -> list[Spec]:
    """Number of concepts x polarity weight x model; without concepts only weight 0."""
    return [
        Spec("grid_search", f"{m}_k{k}_w{w:g}", src, m, "tfidf", 2.0, k, w)
        for k, w, m in product(n_concepts, weights, models)
        if not (k == 0 and w > 0)
    ]


@dataclass(frozen=True)
class _Matrix:
    """A stored matrix, and for each of its sources the columns with df and z."""

    name: str
    rows: DataFrame
    size: int
    n_train: int
    columns: dict[Source, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _shared_source(s: Spec, specs: Sequence[Spec]) -> Source:
    """The source with the widest n-gram range among those that differ in nothing else."""
    same = [x.source.n_range for x in specs if x.k == 0 and replace(x.source, n_range=s.source.n_range) == s.source]
    return replace(s.source, n_range=(min(lo for lo, _ in same), max(hi for _, hi in same)))


def _numbers(df: DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    """Numeric columns on the driver; as many rows as a model has weights."""
    table = df.select(*names).toArrow().combine_chunks()
    order = np.argsort(table[names[0]].to_numpy(), kind="stable")
    return tuple(table[c].to_numpy()[order] for c in names)


def _matrix(spark: SparkSession, specs: Sequence[Spec], store: Store, shared: Source, k: int, w: float,
            embed: Callable | None, encoder: str | None) -> _Matrix:
    """One matrix for all ``specs``, which differ in range, threshold, weighting and model only."""
    docs = assignments(spark, shared, store)
    folds = store.table(lambda: fold_of(docs.where("split = 'train'")), "folds", folder=shared.folder, label=shared.label)
    params = concept_key(shared, k, w, embed, SEED, encoder)
    name = f"k{k} w{w:g} {shared.token_col} {shared.n_range}"
    if k == 0:
        index = store.table(
            lambda: sorted_index(unit_features(spark, shared, store).select("term", "df"), "term"), "unit_index", **params)
        size = index.count()
        cells = join_per_key(unit_matrix(spark, shared, store).drop("df"), index, "term", "doc_id", "df")
        columns = {src: _numbers(join_per_key(unit_features(spark, src, store).select("term", "df", "z"),
                                              index.drop("df"), "term", "term", "idx"), "idx", "df", "z")
                   for src in {s.source for s in specs}}
    else:
        counts, scored, size = concept_matrix(spark, shared, store, k, w, embed, SEED, encoder)
        cells = counts.withColumn("idx", F.col("concept_id"))
        columns = {shared: _numbers(scored, "concept_id", "df", "z")}

    def rows() -> DataFrame:
        structs = feature_structs(docs.select("doc_id", "label", "split"), cells, size, value="cnt")
        return matrix_rows(structs, name, folds)

    stored = store.table(rows, "matrix_rows", **params)
    return _Matrix(name, stored, size, train_size(spark, shared, store), columns)


def _model_spec(s: Spec, m: _Matrix, source: Source) -> linear.Spec | None:
    """The columns that pass the threshold, scaled; None with fewer than two."""
    idx, df, z = m.columns[source]
    kept = np.ones(len(idx), dtype=bool) if s.z is None else np.abs(z) > s.z
    if kept.sum() < 2:
        return None
    if s.weighting not in ("bow", "tfidf"):
        raise ValueError(f"unknown weighting: {s.weighting}")
    idf = np.log((1.0 + m.n_train) / (1.0 + df[kept])) + 1.0
    scale = idf if s.weighting == "tfidf" else np.ones(int(kept.sum()))
    return linear.Spec(s.name, m.name, m.size, idx[kept].astype(np.int64), scale, s.weighting == "tfidf", s.model)


def fit_experiments(
    spark: SparkSession, specs: Iterable[Spec], store: Store, embed: Callable | None = None, encoder: str | None = None,
    parallelism: int = PARALLELISM, local_bytes: int = linear.LOCAL_BYTES,
) -> tuple[list[tuple[Spec, linear.Linear]], DataFrame | None, dict[str, str]]:
    """Fitted models, the rows of their matrices, and the reasons of runs that have none.

    Runs that share their units share one matrix: thresholds and n-gram ranges choose its columns,
    BoW and TF-IDF scale them. All models are fitted together.
    """
    specs = list(specs)
    groups: dict[tuple, list[Spec]] = {}
    for s in specs:
        shared = s.source if s.k else _shared_source(s, specs)
        groups.setdefault((shared, s.k, s.w if s.k else 0.0), []).append(s)
    failed: dict[str, str] = {}

    def build(group: tuple) -> _Matrix | None:
        try:
            return _matrix(spark, groups[group], store, *group, embed, encoder)
        except Exception as error:  # one bad configuration must not stop the series
            failed.update({s.name: f"{type(error).__name__}: {error}" for s in groups[group]})
            return None

    with ThreadPool(max(1, parallelism)) as pool:  # matrices are independent of each other
        matrices = dict(zip(groups, pool.map(build, groups, chunksize=1)))
    wanted: list[tuple[Spec, linear.Spec]] = []
    for group, members in groups.items():
        m = matrices[group]
        for s in members if m is not None else ():
            try:
                model = _model_spec(s, m, s.source if s.k == 0 else group[0])
            except ValueError as error:
                failed[s.name] = f"ValueError: {error}"
                continue
            if model is None:
                failed[s.name] = "fewer than two features"
            else:
                wanted.append((s, model))
    built = [m.rows for m in matrices.values() if m is not None]
    rows = reduce(DataFrame.unionByName, built) if built else None
    if not wanted:
        return [], rows, failed
    models = linear.fit_many(rows.where("split = 'train'"), [x for _, x in wanted], local_bytes=local_bytes)
    done = []
    for (s, _), model in zip(wanted, models):
        if model.error:
            failed[s.name] = model.error
        else:
            done.append((s, model))
    return done, rows, failed


def run_experiments(
    spark: SparkSession, specs: Iterable[Spec], store: Store, split: str = "val",
    embed: Callable | None = None, encoder: str | None = None, parallelism: int = PARALLELISM,
    local_bytes: int = linear.LOCAL_BYTES,
) -> tuple[DataFrame | None, dict[str, str]]:
    """Fit and score every specification.

    Returns stored predictions (experiment, model, split, doc_id, true_label, probability,
    elapsed_s, gradient) and the reasons of the runs that failed or were skipped because fewer
    than two features remain. elapsed_s is the time of the run's own fits, gradient the
    largest norm left in them.
    """
    specs = list(specs)
    done, rows, failed = fit_experiments(spark, specs, store, embed, encoder, parallelism, local_bytes)
    if not done:
        return None, failed
    facts = spark.createDataFrame([(s.experiment, s.name, m.seconds, m.gradient) for s, m in done],
                                  "experiment string, model string, elapsed_s double, gradient double")
    scored = linear.score([m for _, m in done], rows.where(F.col("split") == split))
    preds = scored.join(F.broadcast(facts), "model").select(  # one row per run
        "experiment", "model", "split", "doc_id", "true_label", "probability", "elapsed_s", "gradient")
    return store.table(lambda: preds, "predictions", specs=repr(specs), split=split,
                       embed=encoder_key(embed, encoder)), failed

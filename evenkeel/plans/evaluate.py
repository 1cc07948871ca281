"""Classifier tests around resampling, with samplers and scorers by name."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import generator, metrics, resample, synthetic
from evenkeel.operators.columns import take_features
from evenkeel.operators.encode import MinMax
from evenkeel.operators.profile import covariance, quantiles, score_summary
from evenkeel.operators.splits import (
    nested_folds,
    repeated_folds,
    stratified_split,
    thin_majority,
)
from evenkeel.plans.grid import expand_grid
from evenkeel.plans.sampling import sampling_plan, undersampling_plan
from evenkeel.plans.stacked import SET, STACKED, StackedLogistic
from evenkeel.session import reuse, write_scratch
from evenkeel.sources.files import read_experiment, write_report
from evenkeel.spec import FeatureSpec

#: Independent fits started at once; a session may set ``spark.evenkeel.driverThreads``.
DRIVER_THREADS = 8
#: Training bytes for each partition of a fit.
FIT_BYTES = 64 << 20
#: Spark's bound on the depth of a tree; the trees are grown without a limit of their own.
DEEPEST = 30
SCORE, TRAIN_SHARE, TRAIN_ROWS = "score", "train_share", "train_rows"

# ---- samplers and scorers by name ----------------------------------------------

SAMPLERS: dict[str, Callable] = {}
SCORERS: dict[str, Callable] = {}


def register_sampler(name: str, fn: Callable) -> None:
    """``fn(df, spec, strategy, seed, **params)`` returns the resampled table."""
    SAMPLERS[name] = fn


def register_scorer(name: str, fn: Callable) -> None:
    """``fn(scored, y, score, key, by)`` returns one row per group with a column ``name``."""
    SCORERS[name] = fn


def _random(df, spec, strategy, seed):
    plan = sampling_plan(df, spec.label, strategy)
    return resample.oversample_random(df, spec.label, spec.key, plan, seed)


def _under(df, spec, strategy, seed):
    plan = undersampling_plan(df, spec.label, strategy)
    return resample.undersample_random(df, spec.label, spec.key, plan, seed)


def _smote(df, spec, strategy, seed, k_neighbors=5):
    plan = sampling_plan(df, spec.label, strategy)
    made = synthetic.smote_nc if spec.categorical else synthetic.smote
    return made(df, spec, plan, int(k_neighbors), seed)


def _adasyn(df, spec, strategy, seed, n_neighbors=5):
    return synthetic.adasyn(df, spec, sampling_plan(df, spec.label, strategy), int(n_neighbors), seed)


register_sampler("unbalanced", lambda df, spec, strategy, seed: df)
register_sampler("random", _random)
register_sampler("under", _under)
register_sampler("SMOTE", _smote)
register_sampler("ADASYN", _adasyn)
register_sampler("tomek", lambda df, spec, strategy, seed: synthetic.clean_tomek(df, spec))
register_sampler("generator", lambda df, spec, strategy, seed, **fit: generator.fit_resample(
    df, spec, strategy, seed, **fit))

BUILT_IN = dict(SAMPLERS)

register_scorer("auc", lambda df, y, score, key, by: metrics.auc(df, y, score, by))
register_scorer("tail_lift", lambda df, y, score, key, by: metrics.tail_lift(df, y, score, key, 0.1, by))
register_scorer("top_lift", lambda df, y, score, key, by: metrics.top_lift(df, y, score, key, 0.1, by))
register_scorer("accuracy", lambda df, y, score, key, by: metrics.accuracy(df, y, score, 0.5, by))
register_scorer("f1", lambda df, y, score, key, by: metrics.f1(df, y, score, F.col(TRAIN_SHARE), by))


def score_tables(parts: Sequence[tuple[tuple, DataFrame]], tags: Sequence[str], spec: FeatureSpec,
                 scorers: Sequence[str]) -> list[dict]:
    """Scores of many scored tables in one job per scorer.

    ``parts`` pairs the tag values of a table with the table; the result has one
    dict per part, in order, with its tags and scores.
    """
    stacked = None
    for i, (_, scored) in enumerate(parts):
        share = F.col(TRAIN_SHARE) if TRAIN_SHARE in scored.columns else F.lit(0.5)
        one = scored.select(spec.key, spec.label, SCORE, share.alias(TRAIN_SHARE), F.lit(i).alias("part"))
        stacked = one if stacked is None else stacked.unionByName(one)
    found = score_parts(stacked, spec, scorers)
    none = dict.fromkeys(scorers)
    return [{**dict(zip(tags, values)), **none, **found.get(i, {})} for i, (values, _) in enumerate(parts)]


def score_parts(scored: DataFrame, spec: FeatureSpec, scorers: Sequence[str]) -> dict[int, dict]:
    """Scores of each ``part`` of a scored table; the scorers start together."""
    unknown = [n for n in scorers if n not in SCORERS]
    if unknown:
        raise ValueError(f"no scorers {unknown}; known: {sorted(SCORERS)}")
    scored, out = reuse(scored), {}
    # filled once, so that scorers that start together do not compute it twice
    scored.count()
    found = in_threads(lambda n: SCORERS[n](scored, spec.label, SCORE, spec.key, ["part"]).collect(), list(scorers))
    for name, rows in zip(scorers, found, strict=True):
        for row in rows:
            out.setdefault(row["part"], {})[name] = row[name]
    scored.unpersist()
    return out


def score_with(scored: DataFrame, spec: FeatureSpec, scorers: Sequence[str]) -> dict:
    """The named scores of one scored table as plain numbers."""
    return score_tables([((), scored)], (), spec, scorers)[0]


def in_threads(fn: Callable, jobs: Sequence) -> list:
    """Start independent Spark jobs from a few driver threads; results in order."""
    spark = SparkSession.getActiveSession()
    threads = int(spark.conf.get("spark.evenkeel.driverThreads", str(DRIVER_THREADS))) if spark else DRIVER_THREADS
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(fn, jobs))


# ---- classifiers -----------------------------------------------------------------

def _depth(params: dict) -> int:
    """The depth asked for, or the deepest possible."""
    depth = params.pop("max_depth", None)
    if depth is not None and int(depth) > DEEPEST:
        raise ValueError(f"max_depth {depth}: Spark grows trees to depth {DEEPEST} at most")
    return DEEPEST if depth is None else int(depth)


def classifier(name: str, n_rows: int, params: dict):
    """LR, RF or DT; parameter names follow the experiment files.

    Without parameters trees are grown until their leaves are pure or the depth
    reaches ``DEEPEST``, a forest has 100 trees, and leaves may hold one row.
    """
    common = {"labelCol": "__y", "featuresCol": "__features"}
    p = dict(params)
    if name == "LR":
        c = float(p.pop("C", 1.0))
        made = LogisticRegression(**common, regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0,
                                  standardization=False, maxIter=int(p.pop("max_iter", 100)))
    elif name == "RF":
        made = RandomForestClassifier(
            **common, numTrees=int(p.pop("n_estimators", 100)),
            minInstancesPerNode=int(p.pop("min_samples_leaf", 1)),
            featureSubsetStrategy=str(p.pop("max_features", "sqrt")),
            maxDepth=_depth(p), seed=int(p.pop("seed", 1)))
    elif name == "DT":
        made = DecisionTreeClassifier(
            **common, maxDepth=_depth(p),
            minInstancesPerNode=int(p.pop("min_samples_leaf", 1)),
            minWeightFractionPerNode=float(p.pop("min_weight_fraction_leaf", 0.0)))
    else:
        raise ValueError(f"no classifier {name!r}; known: DT, LR, RF")
    if p:
        raise ValueError(f"unknown parameters {sorted(p)} for {name}")
    return made


def fit_classifier(train: DataFrame, spec: FeatureSpec, model: str = "LR",
                   params: dict | None = None) -> PipelineModel:
    """One-hot the categories (an unseen level is all zeros) and fit the classifier."""
    train = reuse(train.select(
        *[F.col(c).cast("double").alias(c) for c in spec.continuous],
        *[F.col(c).cast("string").alias(c) for c in spec.categorical],
        F.col(spec.label).cast("double").alias("__y")))
    stages, inputs = [], list(spec.continuous)
    if spec.categorical:
        codes = [f"__code_{c}" for c in spec.categorical]
        hot = [f"__hot_{c}" for c in spec.categorical]
        stages.append(StringIndexer(inputCols=list(spec.categorical), outputCols=codes,
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep"))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__features"))
    n = train.count()
    stages.append(classifier(model, n, params or {}))
    # a solver runs a job per step; few bytes in many partitions only add overhead
    parts = max(1, -(-n * 16 * len(train.columns) // FIT_BYTES))
    fitted = Pipeline(stages=stages).fit(train.coalesce(parts))
    train.unpersist()
    if model in ("RF", "DT") and "max_depth" not in (params or {}):
        last = fitted.stages[-1]
        if max(t.depth for t in getattr(last, "trees", [last])) >= DEEPEST:
            raise ValueError(f"a tree reached depth {DEEPEST}; set max_depth or min_samples_leaf")
    return fitted


def apply_classifier(model: PipelineModel, df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Key, label and the probability of class 1."""
    cast = df.select(
        spec.key, spec.label, *[F.col(c).cast("double").alias(c) for c in spec.continuous],
        *[F.col(c).cast("string").alias(c) for c in spec.categorical])
    return model.transform(cast).select(
        spec.key, spec.label, vector_to_array("probability")[1].alias(SCORE))


def fit_score(train: DataFrame, test: DataFrame, spec: FeatureSpec, model: str = "LR",
              params: dict | None = None) -> DataFrame:
    """Fit on one table, score the other."""
    return apply_classifier(fit_classifier(train, spec, model, params), test, spec)


def rank_importance(model: PipelineModel, spec: FeatureSpec, n: int) -> DataFrame:
    """Top ``n`` inputs of a forest: ``(feature, importance, spread)``; spread is over the trees."""
    forest, assembler = model.stages[-1], model.stages[-2]
    names = []
    encoders = {c: s for s in model.stages if hasattr(s, "categorySizes")
                for c in s.getOutputCols()}
    for c in assembler.getInputCols():
        if c in encoders:
            index = model.stages[0]
            at = encoders[c].getOutputCols().index(c)
            names += [f"{index.getInputCols()[at]}={v}" for v in index.labelsArray[at]]
        else:
            names.append(c)
    total = forest.featureImportances.toArray()
    trees = [t.featureImportances.toArray() for t in getattr(forest, "trees", [forest])]
    rows = []
    for i, name in enumerate(names[:len(total)]):
        each = [float(t[i]) for t in trees]
        mean = sum(each) / len(each)
        rows.append((name, float(total[i]), (sum((e - mean) ** 2 for e in each) / len(each)) ** 0.5))
    spark = SparkSession.active()
    table = spark.createDataFrame(rows, "feature string, importance double, spread double")
    return table.orderBy(F.desc("importance"), "feature").limit(n)


# ---- chain of steps ----------------------------------------------------------------

class ResampleChain:
    """Scale, resample, clean, encode and classify; resampling happens only while fitting.

    ``cleaning`` names a second sampler, such as ``tomek``, that runs on the
    resampled rows. ``prepare`` resamples once; ``fit_model`` can then be called
    for many classifiers before ``release``.
    """

    def __init__(self, spec: FeatureSpec, sampler: str = "unbalanced", model: str = "LR",
                 sampler_params: dict | None = None, model_params: dict | None = None,
                 scale: bool = True, seed: int = 0, cleaning: str | None = None):
        for name in (sampler, cleaning):
            if name is not None and name not in SAMPLERS:
                raise ValueError(f"no sampler {name!r}; known: {sorted(SAMPLERS)}")
        self.spec, self.sampler, self.model, self.cleaning = spec, sampler, model, cleaning
        self.sampler_params = dict(sampler_params or {})
        self.model_params = dict(model_params or {})
        self.scale, self.seed = scale, seed
        self.scaler: MinMax | None = None
        self.resampled: DataFrame | None = None
        self.positive_share, self.train_rows = 0.5, 0
        self.fitted: PipelineModel | None = None

    def prepare(self, train: DataFrame) -> "ResampleChain":
        train = self.spec.require(train)
        if self.scale and self.spec.continuous:
            self.scaler = MinMax.fit(train, self.spec.continuous)
            train = self.scaler.transform(train)
        params = dict(self.sampler_params)
        strategy = params.pop("sampling_strategy", "auto")
        rows = SAMPLERS[self.sampler](train, self.spec, strategy, self.seed, **params)
        if self.cleaning:
            # new rows have no key of their own; cleaning needs one
            keyed = write_scratch(rows.select(*self.spec.columns).withColumn(
                self.spec.key, F.monotonically_increasing_id()), "resampled")
            rows = SAMPLERS[self.cleaning](keyed, self.spec, "auto", self.seed)
        self.resampled = reuse(rows.select(*self.spec.features, self.spec.label))
        positive = F.when(F.col(self.spec.label) == 1, 1.0).otherwise(0.0)
        self.train_rows, share = self.resampled.agg(F.count(F.lit(1)), F.avg(positive)).first()
        self.positive_share = 0.5 if share is None else share
        return self

    def fit_model(self, model: str | None = None, params: dict | None = None) -> "ResampleChain":
        if self.resampled is None:
            raise ValueError("prepare the chain before fitting a classifier")
        self.fitted = fit_classifier(self.resampled, self.spec, model or self.model,
                                     self.model_params if params is None else params)
        return self

    def release(self) -> None:
        if self.resampled is not None:
            self.resampled.unpersist()
            self.resampled = None

    def fit(self, train: DataFrame) -> "ResampleChain":
        self.prepare(train).fit_model()
        self.release()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise ValueError("fit the chain before using it")
        scaled = self.scaler.transform(df) if self.scaler else df
        return apply_classifier(self.fitted, scaled, self.spec).withColumn(
            TRAIN_SHARE, F.lit(float(self.positive_share)))


# ---- tests --------------------------------------------------------------------------

def upsampled_scores(train: DataFrame, test: DataFrame, spec: FeatureSpec, sampler: str,
                     model: str = "LR", seed: int = 0, sampler_params: dict | None = None,
                     model_params: dict | None = None, cleaning: str | None = None) -> DataFrame:
    """Resample the training rows, clean them if asked to, fit, give the scored test rows."""
    chain = ResampleChain(spec, sampler, model, sampler_params, model_params, seed=seed, cleaning=cleaning)
    return chain.fit(train).transform(test)


def stacked_parts(models: StackedLogistic, df: DataFrame, members: dict) -> DataFrame:
    """Scored rows of all stacked models; ``part`` numbers (set, resampling, candidate)."""
    per_set = len(models.parts) * len(models.penalties)
    part = F.col(SET) * per_set + F.col("resampling") * len(models.penalties) + F.col("candidate")
    return models.score(df, members).select(
        models.spec.key, models.spec.label, SCORE, F.col("train_share").alias(TRAIN_SHARE), part.alias("part"))


def _linear(model: str, params: dict | None, cleaning: str | None) -> bool:
    """Whether all fits can be made at once."""
    return model == "LR" and set(params or {}) <= {"C"} and cleaning in (None, "tomek")


def _sampler(name: str):
    """The stacked form of a sampler, or the function that is called for each set."""
    if name not in SAMPLERS:
        raise ValueError(f"no sampler {name!r}; known: {sorted(SAMPLERS)}")
    return name if name in STACKED and SAMPLERS[name] is BUILT_IN.get(name) else SAMPLERS[name]


def _resample_all(models: StackedLogistic, resamplings: Sequence[tuple[str, dict]], seed: int,
                  cleaning: str | None) -> None:
    """Resample with each setting; the searches and fits behind them start from a few threads."""
    settings = [int(p.get("k_neighbors", 5)) for name, p in resamplings if name == "SMOTE"]
    models.stack.widest, models.stack.often = max(settings, default=1), len(settings) > 1
    models.add(in_threads(lambda job: models.resampled(_sampler(job[0]), job[1], seed, cleaning is not None),
                          list(resamplings)))


def _together(train: DataFrame, test: DataFrame, spec: FeatureSpec, resamplings: Sequence[tuple[str, dict]],
              params: dict | None, scorers: Sequence[str], seed: int, cleaning: str | None) -> list[dict]:
    """Scores and ``train_rows`` of each resampling of one training table, fitted together."""
    every = {0: F.lit(True)}
    models = StackedLogistic(train, spec, every)
    _resample_all(models, resamplings, seed, cleaning)
    models.fit([float((params or {}).get("C", 1.0))])
    found = score_parts(stacked_parts(models, test, every), spec, scorers)
    sizes = {s // models.step: n for s, (n, _) in models.sizes.items()}
    return [{**dict.fromkeys(scorers), **found.get(i, {}), TRAIN_ROWS: sizes.get(i, 0)} for i in range(len(resamplings))]


def upsampling_eval(train: DataFrame, test: DataFrame, spec: FeatureSpec, samplers: Sequence[str],
                    model: str = "LR", scorers: Sequence[str] = ("auc",), seed: int = 0,
                    sampler_params: dict | None = None, model_params: dict | None = None,
                    cleaning: str | None = None) -> DataFrame:
    """Scores of each sampler on the untouched test rows: ``(sampler, train_rows, scores)``."""
    if _linear(model, model_params, cleaning):
        rows = _together(train, test, spec, [(s, sampler_params or {}) for s in samplers], model_params, scorers,
                         seed, cleaning)
        rows = [{"sampler": s, **row} for s, row in zip(samplers, rows, strict=True)]
        return _table(train.sparkSession, rows, f"sampler string, {TRAIN_ROWS} bigint", scorers)

    def run(sampler: str):
        chain = ResampleChain(spec, sampler, model, sampler_params, model_params, seed=seed, cleaning=cleaning)
        scored = chain.fit(train).transform(test)
        return (sampler, chain.train_rows), scored

    rows = score_tables(in_threads(run, list(samplers)), ["sampler", TRAIN_ROWS], spec, scorers)
    return _table(train.sparkSession, rows, f"sampler string, {TRAIN_ROWS} bigint", scorers)


def _table(spark: SparkSession, rows: list[dict], tags: str, scorers: Sequence[str]) -> DataFrame:
    """Result rows as a table; there are as many as fitted models."""
    schema = ", ".join([tags, *[f"{n} double" for n in scorers]])
    names = [*[t.strip().split(" ")[0] for t in tags.split(", ")], *scorers]
    return spark.createDataFrame([tuple(row[n] for n in names) for row in rows], schema)


def discriminator_eval(real: DataFrame, fake: DataFrame, spec: FeatureSpec, model: str = "RF",
                       params: dict | None = None, folds: int = 2, in_sample: bool = False,
                       seed: int = 0) -> dict:
    """How well a classifier tells synthetic rows from real ones: ``auc``, ``accuracy`` and ``p_value``.

    An AUC near 0.5 is good. Unless ``in_sample``, each fold is scored by a model
    of the other folds, and rows with equal features are in one fold: a model
    never sees the twin of a row it scores. The AUC is that of pairs inside a
    fold. The p-value is that of a permutation of the origins inside the folds,
    with ties, in its normal form. Needs a unique key in both tables.
    """
    origin = FeatureSpec("origin", "row_id", spec.continuous, spec.categorical)
    stacked = resample.label_origin(
        real.select(F.concat(F.lit("r"), F.col(spec.key).cast("string")).alias("row_id"), *spec.features),
        fake.select(F.concat(F.lit("s"), F.col(spec.key).cast("string")).alias("row_id"), *spec.features))
    alike = [F.col(c).cast("double") + F.lit(0.0) for c in spec.continuous]
    alike += [F.col(c).cast("string") for c in spec.categorical]
    fold = F.lit(0) if in_sample else F.pmod(F.xxhash64(F.lit(seed), *alike), F.lit(folds)).cast("int")
    cut = reuse(stacked.withColumn("fold", fold))

    def run(f: int) -> DataFrame:
        train = cut if in_sample else cut.filter(F.col("fold") != f)
        return fit_score(train, cut.filter(F.col("fold") == f), origin, model, params).withColumn("fold", F.lit(f))

    scored = None
    for one in in_threads(run, [0] if in_sample else list(range(folds))):
        scored = one if scored is None else scored.unionByName(one)
    scored = reuse(scored)
    tests = metrics.rank_test(scored, "origin", SCORE, ["fold"]).collect()
    accuracy = metrics.accuracy(scored, "origin", SCORE).first()["accuracy"]
    scored.unpersist()
    cut.unpersist()
    pairs = sum(r["n_pos"] * r["n_neg"] for r in tests)
    won = sum(r["won"] for r in tests)
    spread = sum(r["variance"] for r in tests) ** 0.5
    apart = abs(won - pairs / 2) / spread if spread else 0.0
    return {"auc": won / pairs if pairs else None, "accuracy": accuracy, "p_value": math.erfc(apart / 2 ** 0.5)}


def predictive_eval(real: DataFrame, fake: DataFrame, test: DataFrame, spec: FeatureSpec,
                    model: str = "DT", params: dict | None = None,
                    scorers: Sequence[str] = ("auc",)) -> DataFrame:
    """The same classifier trained on real and on synthetic rows, both scored on real test rows."""
    parts = in_threads(lambda p: ((p[0],), fit_score(p[1], test, spec, model, params)),
                       [("real", real), ("synthetic", fake)])
    rows = score_tables(parts, ["trained_on"], spec, scorers)
    return _table(real.sparkSession, rows, "trained_on string", scorers)


def _sides(cut: DataFrame, held_out) -> tuple[DataFrame, DataFrame]:
    return cut.filter(~held_out), cut.filter(held_out)


def repeat_eval(df: DataFrame, spec: FeatureSpec, samplers: Sequence[str], repeats: int,
                model: str = "LR", test: float = 0.33, scorers: Sequence[str] = ("auc",),
                sd: str = "samp", model_params: dict | None = None) -> DataFrame:
    """Mean and spread of each sampler's scores over repeated splits."""
    cuts = [reuse(stratified_split(spec.require(df), spec.label, test, spec.key, seed=i))
            for i in range(repeats)]

    def run(job):
        sampler, i = job
        return (sampler, i), upsampled_scores(*_sides(cuts[i], F.col("is_test")), spec, sampler, model,
                                              i, model_params=model_params)

    if _linear(model, model_params, None):
        found = in_threads(lambda i: _together(*_sides(cuts[i], F.col("is_test")), spec, [(s, {}) for s in samplers],
                                               model_params, scorers, i, None), list(range(repeats)))
        rows = [{"sampler": s, "repeat": i, **row} for i, part in enumerate(found)
                for s, row in zip(samplers, part, strict=True)]
    else:
        parts = in_threads(run, [(s, i) for i in range(repeats) for s in samplers])
        rows = score_tables(parts, ["sampler", "repeat"], spec, scorers)
    for cut in cuts:
        cut.unpersist()
    table = _table(df.sparkSession, rows, "sampler string, repeat int", scorers)
    return score_summary(table, ["sampler"], list(scorers), sd)


def _mean_sd(values: list) -> tuple[float | None, float | None]:
    """Mean and sample sd of the scores that exist."""
    known = [v for v in values if v is not None]
    if not known:
        return None, None
    mean = sum(known) / len(known)
    sd = (sum((v - mean) ** 2 for v in known) / (len(known) - 1)) ** 0.5 if len(known) > 1 else None
    return mean, sd


def _fold_sets(outer: int, inner: int, tuned: bool) -> dict[int, tuple]:
    """Set number, outer fold and inner fold; the inner fold is None where the whole outer part trains."""
    each = inner + 1
    return {f * each + i: (f, i if i < inner else None) for f in range(outer)
            for i in range(each) if tuned or i == inner}


def _sides_of(sets: dict[int, tuple]) -> tuple[dict, dict]:
    """Which rows train and which test in each set."""
    train, test = {}, {}
    for s, (f, i) in sets.items():
        inside, own = F.col("outer_fold") != f, F.col("inner_fold") == i
        train[s] = inside if i is None else inside & ~own
        test[s] = F.col("outer_fold") == f if i is None else inside & own
    return train, test


def _scored_together(rows: DataFrame, spec: FeatureSpec, samplers: dict, candidates: list[dict], sets: dict,
                     scorers: Sequence[str], seed: int, cleaning: str | None, train_scores: bool) -> list[dict]:
    """Scores of all logistic regressions, each sampler's settings resampled and all sets fitted at once."""
    train, test = _sides_of(sets)
    models = StackedLogistic(rows, spec, train)
    _resample_all(models, [(n, p) for n, settings in samplers.items() for p in settings], seed, cleaning)
    models.fit([float(p.get("C", 1.0)) for p in candidates])
    sides = [test, train] if train_scores else [test]
    found, seen = [*in_threads(lambda side: score_parts(stacked_parts(models, rows, side), spec, scorers), sides), {}][:2]
    out, n = [], 0
    for name, settings in samplers.items():
        for a in range(len(settings)):
            for s, (f, i) in sets.items():
                for b in range(len(candidates)):
                    part = (s * len(models.parts) + n) * len(candidates) + b
                    out.append({
                        "sampler": name, "model": "LR", "fold": f, "candidate": a * len(candidates) + b, "inner": i,
                        TRAIN_ROWS: models.sizes.get(n * models.step + s, (0,))[0],
                        **dict.fromkeys(scorers), **found.get(part, {}),
                        **{f"train_{k}": seen.get(part, {}).get(k) for k in scorers}})
            n += 1
    return out


def nested_cv(df: DataFrame, spec: FeatureSpec, config: dict, outer: int = 5, inner: int = 5,
              scorers: Sequence[str] = ("auc", "tail_lift"), refit: str = "auc",
              seed: int = 123, cleaning: str | None = None,
              train_scores: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nested cross-validation over sampler x model x grid.

    Returns the outer scores ``(sampler, model, fold, candidate, train_rows,
    scores)`` of the candidate that the inner folds chose, and the inner tuning
    results ``(sampler, model, fold, candidate, params, scored_folds, scores,
    their sds)``. ``train_scores`` adds the scores on the rows that trained. A
    fold in which a score does not exist (no positives) is left out of its mean.
    Rows are resampled once for each setting of a sampler and fold; logistic
    regressions of all folds and settings are fitted together, other models one
    by one.
    """
    rows = reuse(nested_folds(spec.require(df), spec.label, outer, inner, spec.key, seed))
    samplers = {s: expand_grid(config["samplers"][s]) for s in config["samplers"]}
    models = {m: expand_grid(config["models"][m]) for m in config["models"]}
    grids = {(s, m): [(a, b) for a in range(len(samplers[s])) for b in range(len(models[m]))]
             for s in samplers for m in models}
    together = [m for m in models if all(_linear(m, p, cleaning) for p in models[m])]
    extra = [f"train_{n}" for n in scorers] if train_scores else []

    def run(job):
        """Fit every wanted classifier on the rows of one resampling: ``[(tags, scored, scored train rows)]``."""
        (sampler, a, fold, i), wanted = job
        part = rows if i is None else rows.filter(F.col("outer_fold") != fold)
        held = F.col("outer_fold") == fold if i is None else F.col("inner_fold") == i
        train, test = _sides(part, held)
        chain = ResampleChain(spec, sampler, sampler_params=samplers[sampler][a], seed=seed, cleaning=cleaning)
        chain.prepare(train)
        found = []
        for model, b in wanted:
            tags = (sampler, model, fold, grids[sampler, model].index((a, b)), i, chain.train_rows)
            fitted = chain.fit_model(model, models[model][b])
            found.append((tags, fitted.transform(test), fitted.transform(train) if train_scores else None))
        chain.release()
        return found

    def scores_of(jobs: dict) -> list[dict]:
        parts = [x for found in in_threads(run, list(jobs.items())) for x in found]
        tags = ["sampler", "model", "fold", "candidate", "inner", TRAIN_ROWS]
        if not parts:
            return []
        sides = [1, 2] if train_scores else [1]
        out, *seen = in_threads(lambda i: score_tables([(p[0], p[i]) for p in parts], tags, spec, scorers), sides)
        for rest in seen:
            out = [{**o, **{f"train_{n}": x[n] for n in scorers}} for o, x in zip(out, rest, strict=True)]
        return out

    jobs: dict[tuple, list] = {}
    for (s, m), grid in grids.items():
        if len(grid) > 1 and m not in together:
            for f in range(outer):
                for i in range(inner):
                    for a, b in grid:
                        jobs.setdefault((s, a, f, i), []).append((m, b))
    # a single candidate needs no inner folds to be chosen
    sure: dict[tuple, list] = {}
    for (s, m), grid in grids.items():
        if len(grid) == 1 and m not in together:
            for f in range(outer):
                sure.setdefault((s, grid[0][0], f, None), []).append((m, grid[0][1]))

    def stacked() -> list[dict]:
        if not together:
            return []
        tuned = any(len(grid) > 1 for (_, m), grid in grids.items() if m in together)
        return _scored_together(rows, spec, samplers, models["LR"], _fold_sets(outer, inner, tuned), scorers,
                                seed, cleaning, train_scores)

    # the regressions, the inner fits and the fits that wait for no choice start side by side
    rows.count()
    fitted, tried, single = in_threads(lambda start: start(), [stacked, lambda: scores_of(jobs), lambda: scores_of(sure)])
    found: dict[tuple, dict] = {}
    for row in tried + [r for r in fitted if r["inner"] is not None and len(grids[r["sampler"], "LR"]) > 1]:
        tags = tuple(row[t] for t in ("sampler", "model", "fold", "candidate"))
        for n in scorers:
            found.setdefault(tags, {}).setdefault(n, []).append(row[n])
    best, tuning = {}, []
    for (s, m, f, c), values in sorted(found.items()):
        stats = {n: _mean_sd(values[n]) for n in scorers}
        level = stats[refit][0]
        # equal means differ in their last digits only; the first candidate then stays
        if level is not None and level > best.get((s, m, f), (float("-inf"), 0))[0] + 1e-10:
            best[s, m, f] = (level, c)
        a, b = grids[s, m][c]
        params = {f"sampler__{k}": str(v) for k, v in samplers[s][a].items()}
        params |= {f"classifier__{k}": str(v) for k, v in models[m][b].items()}
        tuning.append({"sampler": s, "model": m, "fold": f, "candidate": c, "params": params,
                       "scored_folds": sum(v is not None for v in values[refit]),
                       **{n: stats[n][0] for n in scorers}, **{f"{n}_sd": stats[n][1] for n in scorers}})
    chosen = {(s, m, f): best.get((s, m, f), (0.0, 0))[1] for s, m in grids for f in range(outer)}
    final: dict[tuple, list] = {}
    for (s, m, f), c in chosen.items():
        if m not in together and len(grids[s, m]) > 1:
            a, b = grids[s, m][c]
            final.setdefault((s, a, f, None), []).append((m, b))
    scores = single + scores_of(final) + [r for r in fitted if r["inner"] is None
                                 and chosen[r["sampler"], "LR", r["fold"]] == r["candidate"]]
    rows.unpersist()
    spark, head = df.sparkSession, "sampler string, model string, fold int, candidate int"
    return (_table(spark, scores, f"{head}, {TRAIN_ROWS} bigint", [*scorers, *extra]),
            _table(spark, tuning, head + ", params map<string,string>, scored_folds int",
                   [*scorers, *[f"{n}_sd" for n in scorers]]))


def run_experiment(df: DataFrame, spec: FeatureSpec, path: str, folder: str, outer: int = 5,
                   inner: int = 5, scorers: Sequence[str] = ("auc", "tail_lift"), refit: str = "auc",
                   seed: int = 123, cleaning: str | None = None) -> dict[str, DataFrame]:
    """Read an experiment file, cross-validate, write scores, tuning results and their summary."""
    config = read_experiment(df.sparkSession, path)
    unknown = sorted(s for s in config["samplers"] if s not in SAMPLERS)
    if unknown:
        raise ValueError(f"no samplers {unknown}; known: {sorted(SAMPLERS)} (the generator stands for "
                         "neural oversamplers and takes none of their training parameters)")
    scores, tuning = nested_cv(df, spec, config, outer, inner, scorers, refit, seed, cleaning)
    tables = {"scores": scores, "summary": score_summary(scores, ["sampler", "model"], list(scorers)),
              "tuning": tuning.withColumn("params", F.to_json("params"))}
    write_report(tables, folder)
    return tables


def dimension_sweep(df: DataFrame, spec: FeatureSpec, sizes: Sequence[int], samplers: Sequence[str],
                    model: str = "LR", test: float = 0.5, scorers: Sequence[str] = ("auc",),
                    seed: int = 0) -> DataFrame:
    """Scores with the first k features for each k."""
    cut = reuse(stratified_split(spec.require(df), spec.label, test, spec.key, seed))

    def run(job):
        k, sampler = job
        _, fewer = take_features(cut, spec, k)
        return job, upsampled_scores(*_sides(cut, F.col("is_test")), fewer, sampler, model, seed)

    parts = in_threads(run, [(k, s) for k in sizes for s in samplers])
    rows = score_tables(parts, ["n_features", "sampler"], spec, scorers)
    cut.unpersist()
    return _table(df.sparkSession, rows, "n_features int, sampler string", scorers)


def imbalance_sweep(df: DataFrame, spec: FeatureSpec, shares: Sequence[float], model: str = "LR",
                    folds: int = 2, repeats: int = 2, positive=1, seed: int = 0,
                    thin: Callable = thin_majority) -> DataFrame:
    """AUC by repeated cross-validation for each minority share."""
    cuts = {}
    for share in shares:
        thinned = thin(df, spec.label, share, spec.key, positive=positive, seed=seed)
        cuts[share] = reuse(repeated_folds(
            spec.require(thinned), spec.label, folds, spec.key, repeats, seed))

    def run(job):
        share, i, fold = job
        train, test = _sides(cuts[share].filter(F.col("repeat") == i), F.col("fold") == fold)
        return (float(share), i, fold), fit_score(train, test, spec, model)

    jobs = [(s, i, f) for s in shares for i in range(repeats) for f in range(folds)]
    rows = score_tables(in_threads(run, jobs), ["share", "repeat", "fold"], spec, ["auc"])
    for cut in cuts.values():
        cut.unpersist()
    table = _table(df.sparkSession, rows, "share double, repeat int, fold int", ["auc"])
    return score_summary(table, ["share"], ["auc"])


def ratio_sweep(train: DataFrame, test: DataFrame, spec: FeatureSpec, ratios: Sequence[float],
                sampler: str = "random", model: str = "LR", scorers: Sequence[str] = ("auc",),
                seed: int = 0) -> DataFrame:
    """Scores for each wanted minority / majority ratio."""
    if _linear(model, None, None):
        rows = _together(train, test, spec, [(sampler, {"sampling_strategy": r}) for r in ratios], None, scorers,
                         seed, None)
        rows = [{"ratio": float(r), **row} for r, row in zip(ratios, rows, strict=True)]
        return _table(train.sparkSession, rows, "ratio double", scorers)

    def run(ratio):
        return (float(ratio),), upsampled_scores(
            train, test, spec, sampler, model, seed, {"sampling_strategy": ratio})

    rows = score_tables(in_threads(run, list(ratios)), ["ratio"], spec, scorers)
    return _table(train.sparkSession, rows, "ratio double", scorers)


def update_curve(batches: Sequence[DataFrame], test: DataFrame, spec: FeatureSpec, positive=1,
                 model: str = "LR", seed: int = 0) -> DataFrame:
    """AUC after each state update, with the minority replaced by generated rows.

    The running state is written out at each step, so a step never recomputes
    the ones before it.
    """
    state, ranges, seen, parts = None, None, None, []
    for step, batch in enumerate(batches):
        batch = spec.require(batch)
        if state is None:
            state, ranges = generator.fit_state(batch, spec)
        else:
            state = generator.update_state(state, batch, spec, ranges)
        state = write_scratch(state, "generator-state")
        seen = batch if seen is None else seen.unionByName(batch)
        made = generator.generator_from_state(state, spec, batch.schema, ranges)
        n = made.states[str(positive)].n
        plan = sampling_plan(seen, spec.label, {positive: n}, mode="new")
        new = made.sample(plan, seed).withColumn(
            spec.key, F.lit(None).cast(seen.schema[spec.key].dataType))
        mixed = resample.swap_class(seen, new.select(*seen.columns), spec.label, positive)
        parts.append(((step, n), fit_score(mixed, test, spec, model)))
    rows = score_tables(parts, ["step", "n_minority"], spec, ["auc"])
    return _table(test.sparkSession, rows, "step int, n_minority bigint", ["auc"])


def fidelity_report(real: DataFrame, fake: DataFrame, spec: FeatureSpec,
                    probs: Sequence[float] = (0.25, 0.5, 0.75),
                    discriminator: dict | None = None) -> DataFrame:
    """Real against synthetic in one long table ``(check, col, real, synthetic, gap)``.

    Covers means, sds, quantiles, covariances, two-sample distances and the
    level shares of categories; ``discriminator`` scores can be added.
    """
    both = resample.label_origin(real.select(*spec.features), fake.select(*spec.features))
    names = list(spec.continuous)

    def pair(table: DataFrame, name, value: str, check: str) -> DataFrame:
        sides = [F.max(F.when(F.col("origin") == o, F.col(value))).alias(s)
                 for o, s in ((0, "real"), (1, "synthetic"))]
        return table.withColumn("col", name).groupBy("col").agg(*sides).select(
            F.lit(check).alias("check"), "col", "real", "synthetic",
            (F.col("synthetic") - F.col("real")).alias("gap"))

    stats = both.groupBy("origin").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in names], *[F.stddev_pop(c).alias(f"sd_{c}") for c in names])
    parts = []
    for check in ("mean", "sd"):
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{check}_{c}").alias("v")) for c in names])
        long = stats.select("origin", F.explode(cells).alias("x")).select("origin", "x.*")
        parts.append(pair(long, F.col("name"), "v", check))
    q = quantiles(both, names, probs, ["origin"])
    parts.append(pair(q, F.concat_ws(" q", "col", F.col("q").cast("string")), "value", "quantile"))
    parts.append(pair(covariance(both, names, ["origin"]), F.concat_ws(" x ", "a", "b"), "cov", "covariance"))
    none = F.lit(None).cast("double")
    apart = metrics.two_sample_table(both, names, "origin", 0, 1).unpivot(
        ["col"], ["ks", "wasserstein"], "check", "gap")
    parts.append(apart.select("check", "col", none.alias("real"), none.alias("synthetic"), "gap"))
    for c in spec.categorical:
        n = both.groupBy("origin", F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        t = both.groupBy("origin").agg(F.count(F.lit(1)).alias("t"))
        share = n.join(t, "origin").withColumn("v", F.col("n") / F.col("t"))
        parts.append(pair(share, F.concat(F.lit(f"{c}="), F.col("level")), "v", "share"))
    if discriminator:
        rows = [("discriminator", k, None, None, float(v)) for k, v in discriminator.items()]
        parts.append(real.sparkSession.createDataFrame(rows, parts[0].schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

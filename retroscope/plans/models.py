"""Model pipelines and studies on Spark ML.

Vectorisers are always fitted inside the training rows. Scores come back as (key, label,
score) tables and are judged by the exact metrics of operators.metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, OneHotEncoder, RegexTokenizer,
    SQLTransformer, StopWordsRemover, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.functions import text as tx
from retroscope.operators import boosting, forests, metrics, resample, terms, topics, vectors
from retroscope.session import shared_dir

ROWS = 20_000  # of a task that fits: a small table costs few tasks a pass, a large one gets more tasks, not longer ones
AT_ONCE = 5  # folds, and fits within a fold: a fit is a line of short jobs that leaves cores idle


def spoken(df: DataFrame) -> DataFrame:
    """``spoken``: the text the models read; ``has_time``: whether a duration is known."""
    return df.withColumn("spoken", tx.fallback_text()).withColumn(
        "has_time", F.col("time_to_regret_days").isNotNull().cast("int"))


def with_topics(df: DataFrame, key: str, k: int = 10, iterations: int = 500, min_df: int = 5, max_features: int = 10_000) -> tuple[DataFrame, topics.NmfModel]:
    """``topic`` of each row by a factorisation of its 1-2-grams, and the model. A row without a listed
    term is a zero row: its largest load is the first topic's."""
    packed, names = terms.tfidf_vectors(df, key, tx.terms_and_bigrams("spoken"), min_df, max_features)
    model = topics.fit_nmf(packed, names, k, iterations)
    return df.join(model.transform(packed, key).select(key, "topic"), key), model


def with_vectors(df: DataFrame, key: str, components: int = 50, keep: int = 10, dim: int = 384) -> DataFrame:
    """``emb_0`` and so on: the first components of each row's sentence vector."""
    words = tx.tokens("spoken")
    encoder = vectors.fit_hashing(df, words, dim)
    raw = vectors.encode(df.select(key, vectors.joined(words).alias("_words")), "_words", encoder.load)
    reduced, _ = topics.pca_reduce(raw, key, "embedding", components, keep)
    return df.join(reduced.drop("components"), key)


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows for many passes: dealt by key in tasks of about ROWS rows, in order, and persisted. What
    made them ends at the shuffle, so no pass carries it, and fits that draw rows draw the same ones."""
    return df.repartition(max(1, -(-n // ROWS)), key).sortWithinPartitions(key).persist()


def side_by_side(spark, jobs: Sequence[Callable[[], object]]) -> list:
    """What the functions return, AT_ONCE of them at a time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _checkpoints(spark) -> None:
    """A folder for boosting, which ends the lineage of its errors every ten rounds if there is one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _term_stages(text: str) -> list:
    """1-2-grams of a text as ``_terms``."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        StopWordsRemover(inputCol="_w", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
    ]


def studied(df: DataFrame, label: str, key: str, extra: Sequence[str] = (), numeric: Sequence[str] = (),
            categorical: Sequence[str] = (), text: bool = True, **_) -> DataFrame:
    """The columns a study reads, texts as terms: they are cut once for all fits, not once a fold and pass."""
    rows = _labelled(df, label)
    if text:
        rows = PipelineModel(_term_stages("spoken")).transform(rows)
    columns = [key, "label", *extra, *numeric, *categorical, *(["_terms"] if text else [])]
    return rows.select(*dict.fromkeys(columns))


def _apply(prep: PipelineModel, df: DataFrame) -> DataFrame:
    """Features of rows with a text, or with the terms ``studied`` made of it."""
    cut = len(_term_stages("")) if "_terms" in df.columns else 0
    return PipelineModel(prep.stages[cut:]).transform(df)


def fit_text(train: DataFrame, min_df: int = 5, max_features: int = 20_000, text: str = "spoken") -> PipelineModel:
    """1-2-gram TF-IDF of unit length; the vocabulary has at most ``max_features`` terms."""
    ready = _term_stages(text)
    prepared = train if "_terms" in train.columns else PipelineModel(ready).transform(train)
    counts = CountVectorizer(inputCol="_terms", outputCol="_tf", minDF=min_df, vocabSize=max_features).fit(prepared)
    idf = IDF(inputCol="_tf", outputCol="_unused").fit(counts.transform(prepared))
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_tf", outputCol="_tfidf")
    return PipelineModel([*ready, counts, weigh, Normalizer(p=2.0, inputCol="_tfidf", outputCol="text_vec")])


def fit_features(train: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                 text: bool = True, min_df: int = 5, max_features: int = 20_000) -> tuple[PipelineModel, list[str]]:
    """Text, numbers and one-hot categories in one vector, with the name of every slot."""
    stages, inputs, names = [], [], []
    if text:
        vec = fit_text(train, min_df, max_features)
        stages += vec.stages
        inputs.append("text_vec")
        names += list(vec.stages[4].vocabulary)
    for c in categorical:
        index = StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
        hot = OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}", dropLast=True).fit(index.transform(train))
        stages += [index, hot]
    inputs += list(numeric) + [f"_h_{c}" for c in categorical]
    names += list(numeric)
    for c, index in zip(categorical, [s for s in stages if hasattr(s, "labelsArray")]):
        names += [f"{c}_{v}" for v in index.labelsArray[0]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages), names


def filled(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    for c in numeric:
        df = df.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    return df


def logistic(n: int, c: float = 1.0, weight: str | None = None, **kw) -> LogisticRegression:
    """L2 strength C as a sum over rows: Spark averages the loss, hence 1 / (C n)."""
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (c * max(n, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=200, **kw)
    return lr.setWeightCol(weight) if weight else lr


def forest(trees: int = 300, depth: int = 20, seed: int = 42, weight: str | None = None, key: str | None = None):
    """Spark ML's forest, or, where a key is named, the one for few columns."""
    if key:
        return forests.Forest(trees, depth, key, seed, weight)
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth,
                                seed=seed, featureSubsetStrategy="sqrt")
    return rf.setWeightCol(weight) if weight else rf


def boosted(rounds: int = 200, depth: int = 5, rate: float = 0.1) -> boosting.Boosted:
    return boosting.Boosted(rounds, depth, rate)


def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


def scores(model, df: DataFrame, key: str) -> DataFrame:
    return model.transform(df).select(key, F.col("label").cast("int").alias("label"),
                                      F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def prepare(train: DataFrame, test: DataFrame, key: str, **features):
    """Fit features on ``train``; both sides as (key, label, features), train with weights.

    The training side is dealt and persisted: every fit passes over it many times.
    """
    prep, names = fit_features(train, **features)
    ready = resample.class_weights(_apply(prep, train).select(key, "label", "features"), "label")
    return prep, names, dealt(ready, key, train.count()), _apply(prep, test).select(key, "label", "features")


def fit_and_score(train: DataFrame, test: DataFrame, key: str, classifier: Callable[[int], object],
                  **features) -> tuple[DataFrame, PipelineModel, list[str]]:
    """Fit features and classifier on ``train``, score ``test``."""
    prep, names, ready, held = prepare(train, test, key, **features)
    try:
        model = classifier(ready.count()).fit(ready)
    finally:
        ready.unpersist()
    return scores(model, held, key), PipelineModel([*prep.stages, model]), names


def cross_validate(df: DataFrame, label: str, key: str, classifiers: dict[str, Callable[[int], object]], k: int = 5,
                   seed: int = 42, **features) -> dict[str, list[float]]:
    """AUC per stratified fold and classifier; features are fitted once per fold."""
    spark = df.sparkSession
    rows = studied(df, label, key, **features) if "_terms" not in df.columns else df
    data = dealt(resample.with_folds(rows, "label", key, k, seed), key, df.count())

    def fold(i: int) -> list[float]:
        test = data.where(F.col("fold") == i)
        _, _, ready, held = prepare(data.where(F.col("fold") != i), test, key, **features)
        n, held = ready.count(), dealt(held, key, test.count())

        def area(classifier: Callable[[int], object]) -> float:
            # the metric reads its table up to three times, a model scores a row once
            table = scores(classifier(n).fit(ready), held, key).persist()
            try:
                return metrics.auc(table, "label", "score").first()["auc"]
            finally:
                table.unpersist()

        try:
            return side_by_side(spark, [lambda c=c: area(c) for c in classifiers.values()])
        finally:
            ready.unpersist()
            held.unpersist()

    try:
        areas = side_by_side(spark, [lambda i=i: fold(i) for i in range(k)])
        return {name: [a[j] for a in areas] for j, name in enumerate(classifiers)}
    finally:
        data.unpersist()


def compare_models(df: DataFrame, label: str, key: str, classifiers: dict[str, Callable[[int], object]],
                   k: int = 5, reps: int = 2000, seed: int = 42, **features) -> tuple[DataFrame, str, PipelineModel, list[str]]:
    """Cross-validated and held-out AUC with interval per model, and the best on held-out rows."""
    spark = df.sparkSession
    _checkpoints(spark)
    data = dealt(resample.with_split(studied(df, label, key, **features), "label", key, 0.2, seed), key, df.count())
    try:
        train, test = data.where(~F.col("is_test")), data.where("is_test")
        prep, names, ready, held = prepare(train, test, key, **features)
        n, held = ready.count(), dealt(held, key, test.count())
        folds, *fitted = side_by_side(spark, [lambda: cross_validate(train, "label", key, classifiers, k, seed, **features),
                                              *[lambda c=c: c(n).fit(ready) for c in classifiers.values()]])
        rows, best = [], (0.0, "", None)
        for name, model in zip(classifiers, fitted):
            table = scores(model, held, key).persist()
            area = metrics.auc(table, "label", "score").first()["auc"]
            ends = resample.auc_interval(table, "label", "score", key, reps, seed).first()
            table.unpersist()
            rows.append((name, float(np.mean(folds[name])), float(np.std(folds[name])), area, ends["ci_lower"], ends["ci_upper"]))
            if area > best[0]:
                best = (area, name, PipelineModel([*prep.stages, model]))
        ready.unpersist()
        held.unpersist()
        out = spark.createDataFrame(rows, "model string, cv_auc_mean double, cv_auc_std double, test_auc double, "
                                          "ci_lower double, ci_upper double")
        return out.withColumn("best", F.col("model") == best[1]), best[1], best[2], names
    finally:
        data.unpersist()


def importances(spark, model: PipelineModel, names: list[str], k: int = 20) -> DataFrame:
    """Largest |coefficient| or impurity importance."""
    last = model.stages[-1]
    values = np.abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else last.featureImportances.toArray()
    top = np.argsort(-values[:len(names)], kind="stable")[:k]
    return spark.createDataFrame([(i + 1, names[j], float(values[j])) for i, j in enumerate(top)],
                                 "rank int, feature string, importance double")


def signed_terms(spark, model: PipelineModel, names: list[str], k: int = 20) -> DataFrame:
    """Most positive and most negative coefficients."""
    b = model.stages[-1].coefficients.toArray()[:len(names)]
    up, down = np.argsort(-b, kind="stable")[:k], np.argsort(b, kind="stable")[:k]
    rows = [("positive", i + 1, names[j], float(b[j])) for i, j in enumerate(up)]
    rows += [("negative", i + 1, names[j], float(b[j])) for i, j in enumerate(down)]
    return spark.createDataFrame(rows, "side string, rank int, feature string, coefficient double")


def leave_one_group_out(df: DataFrame, label: str, key: str, group: str, groups: Sequence[str],
                        classifier: Callable[[int], object], reps: int = 2000, seed: int = 42, **features) -> DataFrame:
    """Train on all other groups, test on the one left out."""
    spark = df.sparkSession
    data = dealt(studied(df, label, key, [group], **features), key, df.count())

    def left_out(g: str) -> tuple:
        train, test = data.where(F.col(group) != g), data.where(F.col(group) == g)
        table, _, _ = fit_and_score(train, test, key, classifier, **features)
        table = table.persist()
        m = metrics.auc(table, "label", "score").first()
        ends = resample.auc_interval(table, "label", "score", key, reps, seed).first()
        table.unpersist()
        n_test = m["n_pos"] + m["n_neg"]
        return (g, m["auc"], ends["ci_lower"], ends["ci_upper"], train.count(), n_test, m["n_pos"] / n_test,
                [x for x in groups if x != g])

    try:
        rows = side_by_side(spark, [lambda g=g: left_out(g) for g in groups])
        return spark.createDataFrame(rows, "held_out string, test_auc double, ci_lower double, ci_upper double, "
                                           "n_train long, n_test long, rate_test double, trained_on array<string>")
    finally:
        data.unpersist()


def grid_search(df: DataFrame, label: str, key: str, strengths=(0.01, 0.1, 1.0, 5.0), k: int = 5, seed: int = 42,
                **features) -> DataFrame:
    """Fold-mean AUC of every (C, weighting). Features and class weights of a fold are fitted on its
    training rows, once for all cells."""
    cells = {(c, name): lambda n, c=c, weight=weight: logistic(n, c, weight)
             for c, (name, weight) in product(strengths, (("none", None), ("balanced", "weight")))}
    found = cross_validate(df, label, key, cells, k, seed, **features)
    rows = [(c, w, float(np.mean(a))) for (c, w), a in found.items()]
    best = max(r[2] for r in rows)
    return df.sparkSession.createDataFrame([(*r, r[2] == best) for r in rows],
                                           "c double, weighting string, mean_auc double, best boolean")


def nested_feature_sets(df: DataFrame, label: str, key: str, base: Sequence[str], extra: Sequence[str],
                        classifier: Callable[[int], object], k: int = 5, seed: int = 42) -> DataFrame:
    """Fold AUCs of the base columns and of base plus extra, on the same folds."""
    data = filled(df, [*base, *extra])
    one = {"model": classifier}
    small = cross_validate(data, label, key, one, k, seed, numeric=list(base), text=False)["model"]
    large = cross_validate(data, label, key, one, k, seed, numeric=[*base, *extra], text=False)["model"]
    rows = [("base", float(np.mean(small)), float(np.std(small)), 0.0),
            ("extended", float(np.mean(large)), float(np.std(large)), float(np.mean(large) - np.mean(small)))]
    return df.sparkSession.createDataFrame(rows, "features string, mean_auc double, std_auc double, gain double")


def propensity(df: DataFrame, treated: str, covariates: Sequence[str]) -> DataFrame:
    """Adds ``propensity``: probability of treatment from covariates scaled by population deviation."""
    data = filled(df, covariates)
    head = data.agg(*[F.avg(c) for c in covariates], *[F.stddev_pop(c) for c in covariates], F.count(F.lit(1))).first()
    p = len(covariates)
    scaled = data
    for i, c in enumerate(covariates):
        scaled = scaled.withColumn(f"_z{i}", (F.col(c) - F.lit(head[i])) / F.lit(head[p + i] or 1.0))
    x = VectorAssembler(inputCols=[f"_z{i}" for i in range(p)], outputCol="features").transform(
        scaled.withColumn("label", F.col(treated).cast("double")))
    model = logistic(head[2 * p]).fit(x)
    return model.transform(x).select(*data.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("propensity"))


def early_outcome(df: DataFrame, key: str, days: int = 365, seed: int = 42, min_df: int = 3, max_features: int = 20_000):
    """Classifier of "within ``days``": score table of the held-out quarter, model, slot names."""
    known = df.where(F.col("time_to_regret_days").isNotNull()).withColumn(
        "label", (F.col("time_to_regret_days") < days).cast("double"))
    data = resample.with_split(known, "label", key, 0.25, seed)
    return fit_and_score(data.where(~F.col("is_test")), data.where("is_test"), key, lambda n: logistic(n),
                         min_df=min_df, max_features=max_features)


def train_and_export(df: DataFrame, folder: str, min_df: int = 5, domain_min_df: int = 3) -> list[str]:
    """Fit and save the reversal and the domain pipeline; returns the domain label order."""
    numeric = ["vader_compound", "vader_neg", "urgency_score", "has_time"]
    data = _labelled(filled(df, numeric), "reversal")
    prep, _ = fit_features(data, numeric=numeric, min_df=min_df)
    ready = resample.class_weights(prep.transform(data), "label")
    model = logistic(ready.count(), weight="weight").fit(ready)
    PipelineModel([*prep.stages, model]).write().overwrite().save(f"{folder}/reversal_model")
    names = sorted(r[0] for r in df.select("domain").distinct().collect())
    index = F.array_position(F.array(*[F.lit(d) for d in names]), F.col("domain")) - 1
    data = df.withColumn("label", index.cast("double"))
    prep, _ = fit_features(data, min_df=domain_min_df, max_features=10_000)
    ready = prep.transform(data)
    model = logistic(ready.count(), family="multinomial").fit(ready)
    PipelineModel([*prep.stages, model]).write().overwrite().save(f"{folder}/domain_model")
    return names

"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table gives each document a probability per domain. Non-negative
rates per document are then fitted, so that the expected tokens of each domain come close to their
targets while rates stay near one. At the optimum a rate follows from its document and one price per
domain, so the fit looks for the prices (the dual problem, convex and smooth): nothing is kept per
document between steps, and one step is one pass that sums a few numbers over a narrow table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.session import cut_lineage

LABELLED = 10_000  # most labelled rows the classifier is fitted on: those of smallest id hash
FEATURES = 1 << 14
PULL = 1e-3  # how strongly rates are drawn to one
STEPS = 500  # most passes
TOLERANCE = 1e-6  # of all tokens: done when no domain's optimality condition is missed by more


@dataclass
class Mix:
    """Fitted classifier and prices. ``targets`` and ``reached`` are the shares of the budget that each domain
    should get and gets; ``residual`` is how far the optimality condition is missed, in shares of all tokens."""

    domains: list[str]
    model: LogisticRegressionModel | None
    prices: np.ndarray | None = None
    targets: dict[str, float] = field(default_factory=dict)
    reached: dict[str, float] = field(default_factory=dict)
    converged: bool = True
    residual: float = 0.0
    passes: int = 0


def document_domain() -> Column:
    """Domain of a row of the labels table."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def _featured(docs: DataFrame, text: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    counted = docs.withColumn("_words", words).withColumn("_tokens", F.size("_words").cast("double"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_words", outputCol="_features").transform(counted).drop("_words")


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, text: str = "text", id: str = "doc_id",
                most: int = LABELLED) -> Mix:
    """Multinomial logistic regression over the words a text holds, on at most ``most`` labelled rows.
    Rows without an id or domain are not used; of several labels of an id one is taken."""
    named = labels.select(F.col(id).alias("_id"), domain.alias("_domain")).where("_id IS NOT NULL AND _domain IS NOT NULL")
    sample = named.groupBy("_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    sample = cut_lineage(sample)
    domains = sorted(r[0] for r in sample.select("_domain").distinct().limit(1000).collect())
    if len(domains) < 2:
        return Mix(domains, None)
    code = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("_domain")).cast("double") - 1
    # at most ``most`` rows are sent to the scan
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    rows = _featured(rows, "_text").select("_features", code.alias("_code"))
    held = {r[0] for r in rows.select("_code").distinct().collect()}
    if len(held) < 2:
        return Mix([domains[int(c)] for c in held], None)
    fit = LogisticRegression(featuresCol="_features", labelCol="_code", family="multinomial", maxIter=25, regParam=1e-3)
    return Mix(domains, fit.fit(rows))


def with_posteriors(docs: DataFrame, mix: Mix, text: str = "text") -> DataFrame:
    """``docs`` with _tokens (words) and _p (a probability per domain)."""
    if mix.model is None:
        return _featured(docs, text).drop("_features").withColumn("_p", F.array(*[F.lit(1.0) for _ in mix.domains]).cast("array<double>"))
    model = mix.model.copy().setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
    return model.transform(_featured(docs, text)).withColumn("_p", vector_to_array("_probability")).drop(
        "_features", "_probability", "_raw", "_prediction")


def _rates(p: np.ndarray, prices: np.ndarray | None, pull: float) -> np.ndarray:
    """The best rates at these prices; ones without any."""
    return np.ones(len(p)) if prices is None else np.maximum(0.0, 1 - p @ prices / pull)


def _grid(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_rates(profile: DataFrame, mix: Mix, weights: dict[str, float], pull: float = PULL, steps: int = STEPS,
              tolerance: float = TOLERANCE) -> Mix:
    """Rates with the least 1/2 sum_k (a_k - target_k)^2 / mass_k + pull/2 sum_d s_d (rate_d - 1)^2, where
    a_k is the share of tokens that domain k gets, mass_k what documents with a rate above zero have of it
    (lowered in rounds, from all it has, until that moves nothing), s_d the share of document d.

    The rates are max(0, 1 - p_d * prices / pull) where prices_k = (a_k - target_k) / mass_k. Newton steps
    with halving find the prices; what is left of that equation is the optimality residual, and the fit
    has converged only when it is below ``tolerance`` for each domain.

    Targets are ``weights`` of the largest budget that no weighted domain has to repeat tokens for. A
    domain without a weight has target 0, one without tokens is left out. ``profile`` has _tokens and _p.
    """
    width = len(mix.domains)
    if not width:
        return mix

    def sums(prices: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
        """All tokens; what each domain gets; tokens by squared rate; of documents with a rate, what they have of each domain and products of memberships."""
        def add(batches):
            total = np.zeros(width * width + 2 * width + 2)
            for b in batches:
                p, tokens = _grid(b.column(1), width), b.column(0).to_numpy()
                rate = _rates(p, prices, pull)
                total[0] += tokens.sum()
                total[1] += tokens @ rate ** 2
                total[2:2 + width] += (tokens * rate) @ p
                on = rate > 0
                total[2 + width:2 + 2 * width] += tokens[on] @ p[on]
                total[2 + 2 * width:] += ((p[on] * tokens[on, None]).T @ p[on]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "s"])

        found = profile.select("_tokens", "_p").mapInArrow(add, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s"))
        out = np.zeros(width * width + 2 * width + 2)
        for r in found.collect():
            out[r.k] = r.s
        every = out[0] or 1.0
        return out[0], out[2:2 + width] / every, out[1] / every, out[2 + width:2 + 2 * width] / every, out[2 + 2 * width:].reshape(width, width) / every

    at = np.zeros(width)
    all_tokens, gets, squares, active, curve = sums(at)
    if all_tokens <= 0:
        return mix
    mass = gets
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in mix.domains])
    share = np.where(mass > 0, share, 0.0)
    if share.sum() <= 0:
        return mix
    share = share / share.sum()
    budget = min(mass[k] / share[k] for k in range(width) if share[k] > 0)
    target, held = budget * share, mass > 0

    def dual(x: np.ndarray, squares: float) -> float:
        return float(mass @ x ** 2 / 2 + target @ x + pull / 2 * squares)

    passes = 1
    while True:
        value, missed = dual(at, squares), np.where(held, mass * at + target - gets, 0.0)
        while np.abs(missed).max() > tolerance and passes < steps:
            hessian = np.diag(np.where(held, mass, 1.0)) + curve / pull
            move, size = -np.linalg.solve(hessian, missed), 1.0
            while passes < steps:
                to = at + size * move
                _, gets, squares, active, curve = sums(to)
                passes += 1
                left = np.where(held, mass * to + target - gets, 0.0)
                # near the end the value no longer tells steps apart, the residual does
                if dual(to, squares) <= value + 1e-4 * size * float(missed @ move) or np.abs(left).max() < np.abs(missed).max() / 2:
                    break
                size /= 2
            at, value, missed = to, dual(to, squares), left
        lower = np.where(active > 1e-12, np.minimum(mass, active), mass)
        missed = np.where(held, lower * at + target - gets, 0.0)
        if np.abs(missed).max() <= tolerance or passes >= steps:
            break
        mass = lower
    residual = float(np.abs(missed).max())
    named = lambda x: dict(zip(mix.domains, (x / budget).tolist()))
    return Mix(mix.domains, mix.model, at, named(target), named(gets), residual <= tolerance, residual, passes)


def _settled(mix: Mix) -> Mix:
    if not mix.converged:
        raise RuntimeError(f"rates not fitted after {mix.passes} passes: optimality missed by {mix.residual:.3g} of all tokens, "
                           f"reached {mix.reached} for {mix.targets}")
    return mix


def with_rates(profile: DataFrame, mix: Mix, pull: float = PULL) -> DataFrame:
    """``profile`` with _rate behind its columns."""
    width = len(mix.domains)
    if not width:
        return profile.withColumn("_rate", F.lit(1.0))
    prices = mix.prices

    def rate(batches):
        for b in batches:
            r = _rates(_grid(b.column(b.schema.get_field_index("_p")), width), prices, pull)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], schema=b.schema.append(pa.field("_rate", pa.float64())))

    return profile.mapInArrow(rate, profile.select("*").schema.add("_rate", "double"))


def copies(rate: Column, id: Column, seed: int = 7) -> Column:
    """How often a document appears: its rate, rounded up with the chance of its fraction, by a hash of the id."""
    chance = F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def document_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: Column | None = None,
                   text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, posteriors (by domain, in order of their names), rate, copies per row, and in the same
    order as the posteriors domain_targets and domain_reached: shares of the budget, alike in all rows (null
    where no rates were fitted). A fit that is not at its optimum raises.

    Null text counts as empty: no tokens, the probabilities of a text without words. Repeated rows are
    documents of their own; ties do not arise. Without labelled rows of two domains every document
    belongs to the one there is, and without any all rates are one. An empty table gives no rows.
    """
    mix = fit_domains(docs, labels, document_domain() if domain is None else domain, text, id)
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text"))
    profile = cut_lineage(with_posteriors(narrow, mix, "_text").select("doc_id", "_tokens", "_p"))
    mix = _settled(fit_rates(profile, mix, weights))
    rated = with_rates(profile, mix)
    shares = lambda x: F.lit(None).cast("array<double>") if not x else F.array(*[F.lit(float(x[d])) for d in mix.domains])
    return rated.select("doc_id", F.col("_tokens").cast("bigint").alias("n_tokens"), F.col("_p").alias("posteriors"),
                        F.col("_rate").alias("rate"), copies(F.col("_rate"), F.col("doc_id")).alias("copies"),
                        shares(mix.targets).alias("domain_targets"), shares(mix.reached).alias("domain_reached"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: Column | None = None,
          text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents in the target mix, all columns kept: each row as often as its copies say."""
    mix = fit_domains(docs, labels, document_domain() if domain is None else domain, text, id)
    profile = cut_lineage(with_posteriors(docs.select(F.col(text).alias("_text")), mix, "_text").select("_tokens", "_p"))
    mix = _settled(fit_rates(profile, mix, weights))
    # by place: a caller's columns may have any names
    places = [f"c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, places))
    # the rate of ``with_rates`` as an expression: whole documents stay out of Python
    price = [] if mix.prices is None else [float(x) for x in mix.prices]
    rate = F.greatest(F.lit(0.0), 1 - sum((F.get("_p", F.lit(j)) * x for j, x in enumerate(price)), F.lit(0.0)) / PULL)
    rated = with_posteriors(docs.toDF(*places), mix, place[text]).withColumn("_copies", copies(rate, F.col(place[id])))
    kept = rated.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*places)
    return kept.toDF(*docs.columns)

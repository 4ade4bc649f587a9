"""Bootstrap intervals and samples.

One resampler serves all statistics: every row gets a Poisson(1) weight per replicate that is computed from
its key, so a draw does not depend on how rows are dealt out, and a lost task draws the same again. What a
statistic needs of the weighted rows is one of two things:

* sums: any expression over weighted sums of columns (means, rates, ratios, correlations). A task keeps a
  number per term and replicate and sends those, so the shuffle carries replicates, not rows times replicates.
* order: weights by ascending value, for quantiles of values from a bounded domain, and for the AUC, where
  buckets of scores are gone through once and keep three numbers per replicate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retroscope.operators import ranks
from retroscope.operators.relational import vector_sum

# cumulative Poisson(1) probabilities for 0, 1, 2, ...
POISSON_STEPS = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217,
]
PRIME = 2147483647
CHUNK = 512
SUMMED = 128  # rows that are summed at once
CACHED = 1 << 14  # numbers of a block that is hashed at once
HELD = 1 << 24  # numbers a task holds before it hands its sums on
BLOCK = 250  # replicates of a task that needs an order
BUCKET = 50_000  # rows between two cut points of scores; a score with more rows is a bucket of its own


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2 ** 31 - 1 for 0 <= x < 2 ** 62, in 32 bits."""
    low = (x & np.uint64(PRIME)).astype(np.uint32)
    low += (x >> np.uint64(31)).astype(np.uint32)
    return _less_prime(low)


def _less_prime(x: np.ndarray) -> np.ndarray:
    """x less the prime where it is not below it: below, the difference wraps round to a larger number."""
    return np.minimum(x, x - np.uint32(PRIME), out=x)


def _step_table() -> tuple[np.ndarray, np.ndarray]:
    """The first hash of each weight, and the weight by the upper bits of a hash; UNSURE where both sides of
    a step have the same upper bits."""
    steps = np.ceil(np.array(POISSON_STEPS) * PRIME).astype(np.uint32)
    lowest = np.arange(1 << (31 - SHIFT), dtype=np.int64) << SHIFT
    table = np.searchsorted(steps, lowest, "right").astype(np.uint8)
    table[table != np.searchsorted(steps, lowest + (1 << SHIFT) - 1, "right")] = UNSURE
    return steps, table


SHIFT, UNSURE = 15, 255
STEPS, WEIGHTS = _step_table()


def poisson_weights(keys: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Weights (key x rep): two squarings modulo a prime as the hash, then the inverse CDF. Worked on in
    blocks of rows that stay in a core's cache."""
    k = (keys.astype(np.int64) % PRIME * 48271 % PRIME).astype(np.uint32)
    r = ((reps.astype(np.int64) * 69621 + seed * 16807 + 12345) % PRIME).astype(np.uint32)
    last = reps.astype(np.uint64) + np.uint64(7)
    out = np.empty((len(k), len(r)), np.uint8)
    rows = max(1, CACHED // max(1, len(r)))
    for start in range(0, len(k), rows):
        h = _less_prime(k[start:start + rows, None] + r).astype(np.uint64)
        h = _folded(h * (h + np.uint64(1))).astype(np.uint64)
        h *= h
        h += last
        h = _folded(h)
        part = out[start:start + rows]
        np.take(WEIGHTS, h >> np.uint32(SHIFT), out=part, mode="clip")
        unsure = part == UNSURE
        if unsure.any():
            part[unsure] = np.searchsorted(STEPS, h[unsure], "right")
    return out


def key_number(df: DataFrame, key: str) -> Column:
    """A whole number per key: the key itself, or a hash of it."""
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    return F.col(key).cast("bigint") if whole else F.pmod(F.xxhash64(key), F.lit(PRIME))


def replicate_sums(df: DataFrame, by: Sequence[str], key: str | Column, terms: dict[str, Column], reps: int = 2000, seed: int = 42) -> DataFrame:
    """(by, v) with v the weighted sums of the terms, replicate after replicate of the first term, then of
    the next. Null terms count as 0. ``key`` is a non-negative whole number (see ``key_number``)."""
    by, numbers = list(by), np.arange(1, reps + 1)
    rows = df.select(*by, (F.col(key) if isinstance(key, str) else key).cast("bigint").alias("_k"),
                     F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in terms.values()]).alias("_t")).where("_k IS NOT NULL")
    wide = len(terms)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array([g[i] for g in held], types[i]) for i in range(len(by))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))], [*by, "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(i).type for i in range(len(by))]
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))))) if by else [()] * batch.num_rows
            places: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                places.setdefault(g, []).append(i)
            keys = batch.column(len(by)).to_numpy()
            values = batch.column(len(by) + 1).flatten().to_numpy().reshape(-1, wide)
            for g, at in places.items():
                sums = held.setdefault(g, np.zeros((wide, reps)))
                for start in range(0, len(at), SUMMED):
                    part = at[start:start + SUMMED]
                    sums += values[part].T @ poisson_weights(keys[part], numbers, seed).astype(float)
                if len(held) * wide * reps > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("v", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(partial, schema).groupBy(*by).agg(vector_sum("v"))


def bootstrap(df: DataFrame, by: Sequence[str], key: str | Column, terms: dict[str, Column], stat: Column, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(by, rep, stat): a statistic per group and replicate, given as an expression over weighted sums of
    the named terms, ``{"n": lit(1), "s": col("x")}`` and ``col("s") / col("n")`` for a mean."""
    sums = replicate_sums(df, by, key, terms, reps, seed)
    cells = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda i: F.struct(
        (i + 1).alias("rep"), *[F.get("v", i + F.lit(j * reps)).alias(name) for j, name in enumerate(terms)]))
    return sums.select(*by, F.inline(cells)).select(*by, "rep", stat.alias("stat"))


def interval(df: DataFrame, by: Sequence[str], stat: str = "stat", level: float = 0.95) -> DataFrame:
    """Percentile interval over replicates; one bounded list of replicates per group."""
    tail = (1 - level) / 2
    ends = F.percentile(stat, F.array(F.lit(tail), F.lit(1 - tail)))
    return df.groupBy(*by).agg(ends.alias("_e"), F.count(stat).alias("reps")).select(
        *by, F.get("_e", F.lit(0)).alias("ci_lower"), F.get("_e", F.lit(1)).alias("ci_upper"), "reps"
    )


def bootstrap_mean(df: DataFrame, group: str, key: str, value: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Mean per (group, rep); rows without value or group take no part."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    return bootstrap(known, [group], key_number(df, key), {"_n": F.lit(1), "_s": F.col(value)}, F.col("_s") / F.nullif("_n", F.lit(0.0)), reps, seed)


def mean_interval(df: DataFrame, group: str, key: str, value: str, reps: int = 2000, seed: int = 42, min_n: int = 0) -> DataFrame:
    """Group mean, size and bootstrap interval; null interval below ``min_n``."""
    ends = interval(bootstrap_mean(df, group, key, value, reps, seed), [group])
    plain = df.groupBy(group).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return _gated(plain.join(ends.drop("reps"), group, "left"), min_n)


def rate_interval(df: DataFrame, group: str, key: str, outcome: str, reps: int = 2000, seed: int = 42, min_n: int = 0) -> DataFrame:
    """Rate, size and interval of a 0/1 outcome."""
    return mean_interval(df.where(F.col(outcome).isNotNull()), group, key, outcome, reps, seed, min_n).withColumnRenamed("mean", "rate")


def bootstrap_median(df: DataFrame, group: str, key: str, value: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(group, rep, stat): median per group and replicate of a value with a bounded number of different
    values (days below a cap, say). Weights are added up per value first; a task then holds the values of
    one group for BLOCK replicates. Null where a replicate is empty."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("_v"), key_number(df, key).alias("_key"))
    cells = replicate_sums(known, [group, "_v"], "_key", {"n": F.lit(1)}, reps, seed)
    blocks = -(-reps // BLOCK)
    split = cells.select(group, "_v", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.slice("v", b * BLOCK + 1, F.lit(BLOCK)))).alias("block", "w"))

    def middle(t: pa.Table) -> pa.Table:
        value = t.column("_v").to_numpy()
        order = np.argsort(value)
        weights = np.stack(t.column("w").to_pylist())[order]
        reached, value = weights.cumsum(axis=0), value[order]
        total = reached[-1]
        low, high = ((reached > np.floor(at)).argmax(axis=0) for at in ((total - 1) / 2, total / 2))
        stat = np.where(total > 0, (value[low] + value[high]) / 2, np.nan)
        first = t.column("block")[0].as_py() * BLOCK + 1
        return pa.table({group: pa.array([t.column(group)[0].as_py()] * len(stat), t.schema.field(group).type),
                         "rep": pa.array(np.arange(first, first + len(stat)), pa.int32()), "stat": pa.array(stat)})

    schema = T.StructType([df.schema[group], T.StructField("rep", T.IntegerType()), T.StructField("stat", T.DoubleType())])
    found = split.groupBy(group, "block").applyInArrow(middle, schema)
    return found.withColumn("stat", F.when(~F.isnan("stat"), F.col("stat")))


def median_interval(df: DataFrame, group: str, key: str, value: str, reps: int = 2000, seed: int = 42, min_n: int = 10, domain: int = 3651) -> DataFrame:
    """Exact median, size and interval of a value with a bounded number of distinct values."""
    known = df.where(F.col(value).isNotNull())
    plain = ranks.quantiles(known, value, {"median": 0.5}, [group], domain)
    drawn = bootstrap_median(known, group, key, value, reps, seed)
    return _gated(plain.join(interval(drawn, [group]).drop("reps"), group, "left"), min_n)


def _gated(df: DataFrame, min_n: int) -> DataFrame:
    if not min_n:
        return df
    for c in ("ci_lower", "ci_upper"):
        df = df.withColumn(c, F.when(F.col("n") >= min_n, F.col(c)))
    return df


def _run_sums(weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each start to the next. Up to 25 weights of at most 10 fit into a byte."""
    inside = np.arange(len(weights)) - np.repeat(first, np.diff([*first, len(weights)]))
    cut = np.flatnonzero(inside % 25 == 0)
    short = np.add.reduceat(weights, cut, axis=0, dtype=np.uint8)
    return np.add.reduceat(short, np.flatnonzero(inside[cut] == 0), axis=0, dtype=np.uint32)


def _in_order(reps: int, seed: int):
    """Rows by (bucket, score): per bucket the weights of positives and negatives and the pairs that are in
    order, ties half, each per replicate. Keeps one chunk and the running sums."""
    numbers = np.arange(1, reps + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # state: positives, negatives and pairs below the open score, then its own positives and negatives
        bucket = state = score = None

        def fresh():
            return [np.zeros(reps) for _ in range(5)]

        def closed():
            # the last score's ties
            p, n = state[0] + state[3], state[1] + state[4]
            return (bucket, p, n, state[2] + state[3] * (state[1] + state[4] / 2))

        def out(done):
            cols = list(zip(*done)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(list(c), pa.list_(pa.float64())) for c in cols[1:]]], ["bucket", "pos", "neg", "pairs"])

        for batch in batches:
            done = []
            buckets, scores, label, key = (batch.column(i).to_numpy() for i in range(4))
            for start in range(0, batch.num_rows, CHUNK):
                stop = min(start + CHUNK, batch.num_rows)
                cuts = [start, *(start + 1 + np.flatnonzero(np.diff(buckets[start:stop]))), stop]
                for a, z in zip(cuts, cuts[1:]):
                    if buckets[a] != bucket:
                        if bucket is not None:
                            done.append(closed())
                        bucket, state, score = int(buckets[a]), fresh(), None
                    # sums of the runs of one score and label, then a row per score
                    turn = a + np.lexsort((label[a:z], scores[a:z]))
                    first = np.concatenate([[True], (np.diff(scores[turn]) != 0) | (np.diff(label[turn]) != 0)]).nonzero()[0]
                    weights = poisson_weights(key[turn], numbers, seed)
                    runs = _run_sums(weights, first)
                    place = np.concatenate([[0], np.cumsum(np.diff(scores[turn[first]]) != 0)])
                    positive = label[turn[first]] == 1
                    p, n = np.zeros((place[-1] + 1, reps)), np.zeros((place[-1] + 1, reps))
                    p[place[positive]], n[place[~positive]] = runs[positive], runs[~positive]
                    if score is not None and scores[a] == score:
                        p[0] += state[3]
                        n[0] += state[4]
                    elif score is not None:
                        state[2] += state[3] * (state[1] + state[4] / 2)
                        state[0] += state[3]
                        state[1] += state[4]
                    # all but the last score of the chunk are complete
                    below = state[1] + np.cumsum(n, axis=0) - n
                    state[2] += (p[:-1] * (below[:-1] + n[:-1] / 2)).sum(axis=0)
                    state[0] += p[:-1].sum(axis=0)
                    state[1] += n[:-1].sum(axis=0)
                    state[3], state[4], score = p[-1], n[-1], scores[z - 1]
            yield out(done)
        if bucket is not None:
            yield out([closed()])

    return run


def bootstrap_auc(df: DataFrame, label: str, score: str, key: str, reps: int = 2000, seed: int = 42, single: int = BUCKET) -> DataFrame:
    """(rep, stat): AUC per replicate; replicates with one class only are left out.

    Scores are cut into buckets of about ``single`` rows. A task goes through the rows of its buckets by
    score; a score that has more rows is a bucket of its own, whose weights are sums that any task can add
    up. Pairs across buckets follow from the negatives below.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        (F.col(score).cast("double") + F.lit(0.0)).alias("score"), F.col(label).cast("int").alias("label"), key_number(df, key).alias("key"))
    hot = sorted(r[0] for r in rows.groupBy("score").count().where(F.col("count") > single).select("score").collect())  # at most rows / single
    cuts = ranks.bucket_bounds(rows, "score", single=single)
    bounds = sorted({*cuts, *hot, *(float(np.nextafter(h, np.inf)) for h in hot)} - {float("inf"), float("-inf")})
    bucketed = ranks.in_buckets(rows, "score", bounds, "bucket")
    alone = F.col("score").isin(hot) if hot else F.lit(False)
    schema = "bucket int, pos array<double>, neg array<double>, pairs array<double>"
    parts = (bucketed.where(~alone).repartition("bucket").sortWithinPartitions("bucket", "score").select("bucket", "score", "label", "key")
             .mapInArrow(_in_order(reps, seed), schema))
    if hot:
        sums = replicate_sums(bucketed.where(alone), ["bucket"], "key", {"p": F.col("label"), "n": 1 - F.col("label")}, reps, seed)
        halves = sums.select("bucket", F.slice("v", 1, reps).alias("pos"), F.slice("v", reps + 1, reps).alias("neg"))
        parts = parts.union(halves.withColumn("pairs", F.zip_with("pos", "neg", lambda p, n: p * n / 2)))
    per_rep = parts.select("bucket", F.posexplode(F.arrays_zip("pos", "neg", "pairs")).alias("rep", "_s")).select("bucket", "rep", "_s.*")
    below = Window.partitionBy("rep").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    joined = per_rep.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    return joined.groupBy("rep").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.sum(F.col("pairs") + F.col("pos") * F.col("_below")).alias("_c"),
    ).where((F.col("_p") > 0) & (F.col("_n") > 0)).select(
        (F.col("rep") + 1).alias("rep"), (F.col("_c") / (F.col("_p") * F.col("_n"))).alias("stat")
    )


def auc_interval(df: DataFrame, label: str, score: str, key: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Interval of the AUC; (.5, .5) where no replicate has both classes."""
    ends = interval(bootstrap_auc(df, label, score, key, reps, seed), [])
    half: Column = F.lit(0.5)
    return ends.select(F.coalesce("ci_lower", half).alias("ci_lower"),
                       F.coalesce("ci_upper", half).alias("ci_upper"), "reps")


# --- samples ------------------------------------------------------------------------
def stratified_sample(df: DataFrame, strata: list[str], key: str, per_stratum: int,
                      seed: int = 42) -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum in shuffled order."""
    w = Window.partitionBy(*strata).orderBy(ranks.hash_order(seed, key), F.col(key))
    return df.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= per_stratum)


def shuffled(df: DataFrame, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """Rows in shuffled order, the first ``n`` of them if given."""
    ordered = df.orderBy(ranks.hash_order(seed, key), F.col(key))
    return ordered if n is None else ordered.limit(n)


def with_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1, every label spread evenly over the folds."""
    placed = ranks.hash_ordinals(df, key, [label], seed)
    return placed.withColumn("fold", ((F.col("ordinal") - 1) % k).cast("int")).drop(
        "ordinal", "stratum_size"
    )


def with_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` for the given share of every label."""
    placed = ranks.hash_ordinals(df, key, [label], seed)
    cut = F.round(F.col("stratum_size") * F.lit(test_share))
    return placed.withColumn("is_test", F.col("ordinal") <= cut).drop("ordinal", "stratum_size")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k n_c)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    n, k = sum(counts.values()), len(counts)
    pairs = [F.lit(x) for c, m in counts.items() for x in (c, n / (k * m))]
    return df.withColumn(out, F.element_at(F.create_map(*pairs), F.col(label)))

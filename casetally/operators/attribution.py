"""Which features drive a score: linear, tree, sampled Shapley and local surrogate attributions."""

from __future__ import annotations

import binascii
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import ImputerModel, StandardScalerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas import types as pa_types

from casetally.functions import sqltext
from casetally.functions.draws import digest_sql, gaussian_of, pick_sql
from casetally.operators import trees
from casetally.operators.models import FittedModel, as_doubles, bad_probability, with_scores
from casetally.operators.sampling import sample_rows
from casetally.operators.trees import Ensemble, arrow_matrix
from casetally.session import task_count


def unpivot_weights(wide: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Attribution matrix to one row per (case, feature)."""
    items = sqltext.array(f"named_struct('feature', '{f}', 'weight', cast({sqltext.name(f)} AS double))" for f in features)
    return wide.selectExpr(*map(sqltext.name, keys), f"inline({items})")


def background_means(df: DataFrame, columns: Sequence[str], n: int = 100, key: str = "case_id", seed: int = 42) -> dict[str, float]:
    """Column means over a background sample of at most n rows."""
    means = [F.expr(f"avg({sqltext.name(c)}) AS {sqltext.name(c)}") for c in columns]
    return sample_rows(df.select(key, *columns), n, key, seed).agg(*means).first().asDict()


def linear_weights(coefficients: dict[str, float], means: dict[str, float]) -> dict[str, str]:
    """SQL for the contribution of each feature to a linear score, against the background.

    A missing value contributes nothing.
    """
    return {
        f: f"coalesce({sqltext.double(c)} * ({sqltext.name(f)} - {sqltext.double(means[f])}), 0D)" for f, c in coefficients.items()
    }


def linear_attribution(df: DataFrame, coefficients: dict[str, float], means: dict[str, float], key: str = "case_id") -> DataFrame:
    return df.selectExpr(sqltext.name(key), *[f"{w} AS {sqltext.name(f)}" for f, w in linear_weights(coefficients, means).items()])


def logistic_parts(model: PipelineModel, columns: Sequence[str]) -> tuple[dict[str, float], dict[str, float], float]:
    """Medians, coefficients on the raw features, and intercept of a fitted logistic regression."""
    scaler, regression = model.stages[-2], model.stages[-1]
    medians = model.stages[0].surrogateDF.first()
    spread = {c: float(s) for c, s in zip(columns, scaler.std)}
    coefficients = {c: float(b) / spread[c] if spread[c] else 0.0 for c, b in zip(columns, regression.coefficients)}
    intercept = float(regression.intercept) - sum(coefficients[c] * float(m) for c, m in zip(columns, scaler.mean))
    return {c: float(medians[c]) for c in columns}, coefficients, intercept


def logistic_log_odds(model: PipelineModel, columns: Sequence[str]) -> Column:
    """Log-odds of Bad from the coefficients, as one expression."""
    medians, coefficients, intercept = logistic_parts(model, columns)
    terms = [f"{sqltext.double(b)} * coalesce({sqltext.name(c)}, {sqltext.double(medians[c])})" for c, b in coefficients.items()]
    return F.expr(" + ".join([sqltext.double(intercept), *terms]))


def logistic_attribution(
    model: PipelineModel, train: DataFrame, cases: DataFrame, columns: Sequence[str], n_background: int = 100, key: str = "case_id", seed: int = 42
) -> DataFrame:
    """Linear attribution of a fitted logistic regression on its standardised inputs."""
    medians, coefficients, _ = logistic_parts(model, columns)

    def filled(df: DataFrame) -> DataFrame:
        return as_doubles(df, columns).na.fill(medians)

    means = background_means(filled(train), columns, n_background, key, seed)
    return linear_attribution(filled(cases), coefficients, means, key)


def background_rows(df: DataFrame, columns: Sequence[str], n: int = 100, key: str = "case_id", seed: int = 42) -> np.ndarray:
    """At most n rows, an argument of the explainers; missing values are NaN."""
    rows = sample_rows(as_doubles(df, columns).select(key, *columns), n, key, seed).collect()
    return np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows], float).reshape(len(rows), len(columns))


def tree_attribution(
    model: FittedModel, train: DataFrame, cases: DataFrame, columns: Sequence[str], n_background: int = 100, key: str = "case_id", seed: int = 42
) -> DataFrame:
    """Exact Shapley values of a forest's P(Bad), or of the log-odds of boosted trees, against a background sample.

    (case, feature, weight, score, expected); the weights of a case add up to its score less the expected one.
    """
    ensemble = model if isinstance(model, Ensemble) else trees.forest_ensemble(model, columns)
    return trees.attribution(ensemble, as_doubles(cases, columns), background_rows(train, columns, n_background, key, seed), key)


def _walk_points(batches: Iterator[pa.RecordBatch], names: Sequence[str], d: int) -> Iterator[pa.RecordBatch]:
    """The points of each walk, from the background row to the case, with the feature just changed and the next one."""
    steps = np.arange(d + 1)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            n = part.num_rows
            order = arrow_matrix(part["_order"], d).astype(np.int32)
            turn = np.argsort(order, axis=1) + 1  # the step at which each feature changes
            own, other, none = arrow_matrix(part["_x"], d), arrow_matrix(part["_b"], d), np.full((n, 1), -1, np.int32)
            gain, loss = np.concatenate([none, order], 1).ravel(), np.concatenate([order, none], 1).ravel()
            points = [np.where(turn[:, j, None] <= steps, own[:, j, None], other[:, j, None]).ravel() for j in range(d)]
            arrays = [part["k"].take(pa.array(np.repeat(np.arange(n), d + 1))), *[pa.array(v, mask=v < 0) for v in (gain, loss)]]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(v, from_pandas=True) for v in points]], list(names))


def _walk_effects(batches: Iterator[pa.RecordBatch], names: Sequence[str], about: tuple, pool: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What each feature changes of a logistic P(Bad) along the walks of a case, added up over those that lie together.

    A step changes the log-odds by the difference of one term, so a walk's scores come from one running sum.
    """
    medians, slopes, intercept = about
    terms = lambda x: np.where(np.isnan(x), medians, x) * slopes
    others, d = terms(pool), len(slopes)
    for batch in batches:
        if not batch.num_rows:
            continue
        digests = np.frombuffer(binascii.unhexlify("".join(batch["_h"].to_pylist())), ">u8").reshape(-1, d)
        order = np.argsort(digests.astype(np.uint64), axis=1, kind="stable")
        other = others[batch["_b"].to_numpy()]
        change = np.take_along_axis(terms(arrow_matrix(batch["_x"], d)) - other, order, 1)
        odds = np.cumsum(np.column_stack([intercept + other.sum(1), change]), 1)
        with np.errstate(over="ignore"):
            effect = np.empty_like(change)
            np.put_along_axis(effect, order, np.diff(1.0 / (1.0 + np.exp(-odds)), axis=1), 1)
        first = np.flatnonzero(batch["_p"].to_numpy() == 0)
        first = first if len(first) and not first[0] else np.concatenate([[0], first])
        sums = np.add.reduceat(effect, first, 0)
        yield pa.RecordBatch.from_arrays([batch["k"].take(pa.array(first)), *[pa.array(v) for v in np.ascontiguousarray(sums.T)]], list(names))


def sampled_shapley(
    model: PipelineModel,
    cases: DataFrame,
    background: DataFrame,
    columns: Sequence[str],
    n_permutations: int = 8,
    n_background: int = 16,
    key: str = "case_id",
    seed: int = 42,
) -> DataFrame:
    """Shapley values of P(Bad) by random feature orders, as (case, feature, weight).

    For each case and order, features change one by one from a background row
    to the case. The points of a logistic regression are scored from its coefficients
    in one Arrow pass, which adds up a case's walks. For other models an Arrow pass makes
    the points; every scored point counts for the feature just changed and against the
    next one, so one aggregate where the cases lie adds up all differences. Work grows
    with cases x orders x features.
    """
    d = len(columns)
    # At most n_background rows, an argument, so they can travel in the plan.
    rows = [[r[c] for c in columns] for r in sample_rows(as_doubles(background, columns), n_background, key, seed).collect()]
    if [type(s) for s in getattr(model, "stages", [])] == [ImputerModel, VectorAssembler, StandardScalerModel, LogisticRegressionModel]:
        return _logistic_shapley(model, cases, rows, columns, n_permutations, key, seed)
    pool = F.expr(
        sqltext.array(sqltext.array("cast(NULL AS double)" if v is None else sqltext.double(v) for v in row) for row in rows)
    )
    quoted = [sqltext.name(c) for c in columns]
    id_ = sqltext.name(key)
    # Each case turns into many points: the number of tasks is given, as cases alone would look small.
    spread = as_doubles(cases, columns).repartition(task_count(cases.sparkSession), key)
    walks = spread.selectExpr(id_, f"{sqltext.array(quoted)} AS _x", f"explode(sequence(0, {n_permutations - 1})) AS _p")
    order = sqltext.array(
        f"named_struct('h', md5(concat_ws('|', '{seed}', cast({id_} AS string), cast(_p AS string), '{c}')), 'j', {j})"
        for j, c in enumerate(columns)
    )
    walks = walks.select(
        key,
        "_x",
        F.expr(f"transform(array_sort({order}), s -> s.j) AS _order"),
        F.element_at(pool, F.expr(f"cast({pick_sql(len(rows), f'{seed}-row', id_, '_p')} + 1 AS int)")).alias("_b"),
    )
    kind = cases.schema[key].dataType.simpleString()
    shape = ", ".join([f"{id_} {kind}", "_gain int", "_loss int", *[f"{c} double" for c in quoted]])
    points = walks.select(F.col(key).alias("k"), "_x", "_b", "_order").mapInArrow(lambda batches: _walk_points(batches, [key, "_gain", "_loss", *columns], d), shape)
    scored = model.transform(points).select(key, "_gain", "_loss", bad_probability().alias("_prob"))
    effects = scored.selectExpr(id_, "inline(array(named_struct('j', _gain, 'v', _prob), named_struct('j', _loss, 'v', -_prob)))").where("j IS NOT NULL")
    names = F.array(*[F.lit(c) for c in columns])
    return effects.groupBy(key, "j").agg((F.sum("v") / n_permutations).alias("weight")).select(
        key, F.element_at(names, F.col("j") + 1).alias("feature"), "weight"
    )


def _logistic_shapley(model: PipelineModel, cases: DataFrame, rows: list[list], columns: Sequence[str], n_permutations: int, key: str, seed: int) -> DataFrame:
    """Sampled Shapley values of a logistic regression, with the orders and background rows that other models get."""
    d, id_, kind = len(columns), sqltext.name(key), cases.schema[key].dataType.simpleString()
    medians, slopes, intercept = logistic_parts(model, columns)
    about = np.array([medians[c] for c in columns]), np.array([slopes[c] for c in columns]), intercept
    pool = np.array([[np.nan if v is None else v for v in row] for row in rows], float).reshape(len(rows), d)
    # Each case turns into many digests: the number of tasks is given, as cases alone would look small.
    spread = as_doubles(cases, columns).repartition(task_count(cases.sparkSession), key)
    walks = spread.selectExpr(f"{id_} AS k", f"{sqltext.array(map(sqltext.name, columns))} AS _x", f"explode(sequence(0, {n_permutations - 1})) AS _p")
    walks = walks.selectExpr("*", f"concat_ws('|', '{seed}', cast(k AS string), cast(_p AS string), '') AS _w")
    # 64 bits of a digest give the order of the features.
    digests = ", ".join(f"substring(md5(concat(_w, '{c}')), 1, 16)" for c in columns)
    walks = walks.selectExpr("k", "_x", "_p", f"concat({digests}) AS _h", f"cast({pick_sql(len(rows), f'{seed}-row', 'k', '_p')} AS int) AS _b")
    sums = [f"_s{j}" for j in range(d)]
    made = walks.mapInArrow(lambda batches: _walk_effects(batches, ["k", *sums], about, pool), ", ".join([f"k {kind}", *[f"{s} double" for s in sums]]))
    totals = made.groupBy("k").agg(*[F.sum(s).alias(s) for s in sums])
    each = sqltext.array(f"named_struct('feature', '{c}', 'weight', {s} / {n_permutations})" for c, s in zip(columns, sums, strict=True))
    return totals.selectExpr(f"k AS {id_}", f"inline({each})")


def _normal_sums(batches: Iterator[pa.RecordBatch], width: float, d: int, scores: Sequence[str] = ("_prob",)) -> Iterator[tuple[list, np.ndarray]]:
    """(keys, sums) of the neighbourhoods in a task: for each case and score the weighted products of (1, z, y) with themselves.

    Samples of a case lie one after another; what a batch ends in the midst of is carried to the next.
    """
    key, rest, each = None, None, len(scores)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch["k"].to_pylist()
        z = arrow_matrix(batch["_z"], d)
        off = z - arrow_matrix(batch["_own"], d)
        w = np.sqrt(np.exp(-(off**2).sum(1) / width**2))
        made = [np.column_stack([np.ones(len(z)), off, batch[s].to_numpy()]) for s in scores]  # around the case, where the weight lies
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        ends = [*starts[1:], len(keys)]
        sums = np.stack([(v[a:b] * w[a:b, None]).T @ v[a:b] for a, b in zip(starts, ends, strict=True) for v in made])
        names = [keys[a] for a in starts]
        if rest is not None and names[0] == key:
            sums[:each] += rest
        elif rest is not None:
            names, sums = [key, *names], np.concatenate([rest, sums])
        key, rest = names[-1], sums[-each:]
        if len(names) > 1:
            yield names[:-1], sums[:-each]
    if rest is not None:
        yield [key], rest


def _solve(sums: np.ndarray, scale: float, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, R2 and largest residual of the normal equations of many weighted linear models at once."""
    m = sums / sums[:, :1, :1]  # a case very far from the mean can leave next to no weight anywhere else
    mean = m[:, 0, 1:]
    cov = m[:, 1:, 1:] - mean[:, :, None] * mean[:, None, :]
    a, c, total = cov[:, :-1, :-1], cov[:, :-1, -1], np.maximum(cov[:, -1, -1], 0.0)
    left = a * scale + ridge * np.eye(a.shape[1])
    beta = np.linalg.solve(left, (c * scale)[..., None])[..., 0]
    missed = total - 2 * (beta * c).sum(1) + np.einsum("ni,nij,nj->n", beta, a, beta)
    r2 = np.where(total > 1e-14, 1.0 - missed / np.where(total > 1e-14, total, 1.0), 0.0)
    return beta, r2, np.abs(np.einsum("nij,nj->ni", left, beta) - c * scale).max(1)


def local_surrogate(
    score: Callable[[DataFrame], DataFrame],
    train: DataFrame,
    cases: DataFrame,
    columns: Sequence[str],
    n_samples: int = 256,
    fill: float | None = None,
    ridge: float = 1.0,
    key: str = "case_id",
    seed: int = 42,
) -> DataFrame:
    """Weights and fit of a weighted linear model around each case, as (case, feature, weight, r2, residual).

    ``score`` adds ``_prob`` to a table of the features.
    """
    return local_surrogates({"": score}, train, cases, columns, n_samples, fill, ridge, key, seed).drop("system")


def local_surrogates(
    scores: dict[str, Callable[[DataFrame], DataFrame]],
    train: DataFrame,
    cases: DataFrame,
    columns: Sequence[str],
    n_samples: int = 256,
    fill: float | None = None,
    ridge: float = 1.0,
    key: str = "case_id",
    seed: int = 42,
) -> DataFrame:
    """Surrogates of several scores around each case, as (system, case, feature, weight, r2, residual).

    The samples of a case are the same for all scores and are drawn once. The neighbourhood is drawn around the training mean and
    weighted by its distance to the case in standard units. Missing values are taken as the mean, or as ``fill``.
    Cases are spread by key once; their samples are drawn and scored where they lie, and one Arrow pass adds up
    the normal equations and solves those of a batch of cases together. ``residual`` is what is left of them.
    """
    d = len(columns)
    table = as_doubles(train, columns)
    source = table if fill is None else table.na.fill(fill, subset=list(columns))
    quoted = [sqltext.name(c) for c in columns]
    stats = source.agg(*[F.expr(f"{f}({c}) AS {f}_{j}") for f in ("avg", "stddev_pop") for j, c in enumerate(quoted)]).first()
    mean = [float(stats[f"avg_{j}"] or 0.0) for j in range(d)]
    std = [float(stats[f"stddev_pop_{j}"] or 0.0) or 1.0 for j in range(d)]
    blank = mean if fill is None else [fill] * d

    id_ = sqltext.name(key)
    own = sqltext.array(
        f"(coalesce({c}, {sqltext.double(blank[j])}) - {sqltext.double(mean[j])}) / {sqltext.double(std[j])}" for j, c in enumerate(quoted)
    )
    # Each case turns into many samples: the number of tasks is given, as cases alone would look small.
    spread = as_doubles(cases, columns).repartition(task_count(cases.sparkSession), key)
    drawn = spread.selectExpr(id_, f"{own} AS _own", f"explode(sequence(0, {n_samples - 1})) AS _i")
    # A digest gives both halves of a draw; as a column of its own it is worked out once.
    digests = sqltext.array(digest_sql(seed, id_, "_i", f"'{c}'") for c in columns)
    drawn = drawn.selectExpr(id_, "_own", "_i", f"{digests} AS _digests")
    draws = sqltext.array(gaussian_of(f"_digests[{j}]") for j in range(d))
    drawn = drawn.selectExpr(id_, "_own", f"CASE WHEN _i = 0 THEN _own ELSE {draws} END AS _z")
    points = drawn.selectExpr(
        id_, "_own", "_z", *[f"_z[{j}] * {sqltext.double(std[j])} + {sqltext.double(mean[j])} AS {c}" for j, c in enumerate(quoted)]
    )
    kept = points.columns
    for i, score in enumerate(scores.values()):
        points = score(points).select(*kept, F.col("_prob").alias(f"_prob{i}"))
        kept = points.columns
    systems, probs = list(scores), [f"_prob{i}" for i in range(len(scores))]
    scored = points.select(F.col(key).alias("k"), "_own", "_z", *probs)
    width = 0.75 * float(np.sqrt(d))
    kind = pa_types.to_arrow_type(cases.schema[key].dataType)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sums in _normal_sums(batches, width, d, probs):
            for i, system in enumerate(systems):
                beta, r2, residual = _solve(np.ascontiguousarray(sums[i :: len(systems)]), n_samples, ridge)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([system] * beta.size, pa.string()), pa.array(np.repeat(np.array(names, object), d), kind),
                        pa.array(list(columns) * len(names), pa.string()), pa.array(beta.ravel()), pa.array(np.repeat(r2, d)), pa.array(np.repeat(residual, d)),
                    ],
                    ["system", key, "feature", "weight", "r2", "residual"],
                )

    shape = f"system string, {id_} {cases.schema[key].dataType.simpleString()}, feature string, weight double, r2 double, residual double"
    return scored.mapInArrow(fit, shape)


def scorer(model: FittedModel) -> Callable[[DataFrame], DataFrame]:
    """A fitted model as the ``score`` of a surrogate."""
    return lambda df: with_scores(df, model, "_label", "_prob")


def fit_quality(surrogate: DataFrame, by: Sequence[str] = (), key: str = "case_id") -> DataFrame:
    """Mean and least R2 over the cases."""
    per_case = surrogate.groupBy(*by, key).agg(F.max("r2").alias("r2"))
    return per_case.groupBy(*by).agg(F.count("*").alias("n_cases"), F.avg("r2").alias("mean_r2"), F.min("r2").alias("min_r2"))

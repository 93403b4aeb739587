"""The provided star-schema and event tables, seen as applicants, runs and responses.

Every figure is an integer or a floor of a ratio of integers, so that it does
not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casetally.functions import sqltext
from casetally.functions.draws import uniform
from casetally.operators.agreement import top_features_of_row
from casetally.operators.attribution import linear_weights
from casetally.operators.prepare import encode_sentinels, encode_target, usable_rows
from casetally.operators.trees import Ensemble, ensemble_of
from casetally.schema import FEATURE_NAMES, FEATURES, TARGET
from casetally.session import task_count
from casetally.sources.kept import kept

MODELS = ["logreg", "rf", "boosted"]
METHODS = ["shap", "lime"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A provided table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_applicants(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer with the 23 features, sentinel codes in place, and a Good/Bad target."""
    # Orders are reduced to one row each before they meet, customers likewise:
    # a customer with very many orders is summed up before the shuffle.
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        *map(
            F.expr,
            [
                "count(*) AS items",
                "count_if(l_returnflag = 'R') AS returned",
                "sum(cast(rint(l_discount * 100) AS bigint)) AS discount",
                "sum(cast(rint(l_tax * 100) AS bigint)) AS tax",
                "max(CASE WHEN l_returnflag = 'R' THEN to_date(l_shipdate) END) AS last_return",
            ],
        )
    )
    orders = table(spark, sf, "orders")
    newest = orders.agg(F.max(F.to_date("o_orderdate"))).scalar()
    dated = orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.datediff(newest, F.to_date("o_orderdate")).alias("age")
    )
    per_customer = (
        dated.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            *map(
                F.expr,
                [
                    "count(*) AS n_orders",
                    "count_if(o_orderstatus = 'F') AS n_done",
                    "count_if(o_orderstatus = 'O') AS n_open",
                    "count_if(o_orderstatus = 'P') AS n_part",
                    "count_if(o_orderpriority = '1-URGENT') AS n_urgent",
                    "max(age) AS oldest",
                    "min(age) AS latest",
                    "sum(age) AS ages",
                    "count_if(age <= 360) AS n_year",
                    "count_if(age <= 180) AS n_half",
                    "count_if(age <= 180 AND age > 7) AS n_half_late",
                    "min(CASE WHEN age > 7 THEN age END) AS late",
                    "coalesce(sum(items), 0) AS items",
                    "coalesce(sum(returned), 0) AS returned",
                    "coalesce(sum(discount), 0) AS discount",
                    "coalesce(sum(tax), 0) AS tax",
                ],
            ),
            F.datediff(newest, F.max("last_return")).alias("since_return"),
        )
    )
    people = table(spark, sf, "customer").join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    share = "100 * returned / nullif(items, 0)"
    plain = {
        "ExternalRiskEstimate": "40 + floor((c_acctbal + 1000) / 220)",
        "MSinceOldestTradeOpen": "floor(oldest / 30)",
        "MSinceMostRecentTradeOpen": "floor(latest / 30)",
        "AverageMInFile": "floor(ages / n_orders / 30)",
        "NumSatisfactoryTrades": "n_done",
        "NumTrades60Ever2DerogPubRec": "floor(returned / 4)",
        "NumTrades90Ever2DerogPubRec": "floor(returned / 8)",
        "PercentTradesNeverDelq": "floor(1000 * (items - returned) / nullif(items, 0)) / 10",
        "MSinceMostRecentDelq": "greatest(0, floor(since_return / 30))",
        "MaxDelq2PublicRecLast12M": "c_custkey % 10",
        "MaxDelqEver": "CASE WHEN c_custkey % 29 = 5 THEN 10 ELSE 2 + c_custkey % 8 END",
        "NumTotalTrades": "n_orders",
        "NumTradesOpeninLast12M": "n_year",
        "PercentInstallTrades": "floor(100 * n_part / n_orders)",
        "MSinceMostRecentInqexcl7days": "floor(late / 30)",
        "NumInqLast6M": "n_half",
        "NumInqLast6Mexcl7days": "n_half_late",
        "NetFractionRevolvingBurden": "floor(100 * discount / nullif(items, 0)) / 10",
        "NetFractionInstallBurden": "floor(100 * tax / nullif(items, 0)) / 10",
        "NumRevolvingTradesWBalance": "n_open",
        "NumInstallTradesWBalance": "n_part",
        "NumBank2NatlTradesWHighUtilization": "n_urgent",
        "PercentTradesWBalance": "floor(100 * (n_open + n_part) / n_orders)",
    }

    def coded(feature: str) -> str:
        planted = " ".join(f"WHEN {condition} THEN {code}" for condition, code in SENTINELS.get(feature, []))
        return f"cast(CASE WHEN c_custkey % 17 = 0 THEN -9 {planted} ELSE coalesce({plain[feature]}, -8) END AS double) AS {feature}"

    # A fixed limit near the median, so that the target needs no pass of its own.
    bad = f"c_custkey % 3 = 0 OR coalesce({share} > 33, false)"
    return people.selectExpr("c_custkey AS case_id", *map(coded, FEATURE_NAMES), f"CASE WHEN {bad} THEN 'Bad' ELSE 'Good' END AS {TARGET}")


# Feature -> (condition, code), the first that holds; customers whose key divides by 17 have no record at all.
SENTINELS = {
    "ExternalRiskEstimate": [("c_custkey % 37 = 1", -9)],
    "MSinceOldestTradeOpen": [("c_custkey % 31 = 1", -8)],
    "MSinceMostRecentDelq": [("c_custkey % 11 = 0", -8), ("c_custkey % 7 = 3 OR since_return IS NULL", -7)],
    "MSinceMostRecentInqexcl7days": [("c_custkey % 13 = 2", -8), ("c_custkey % 13 = 4", -7)],
    "NetFractionRevolvingBurden": [("c_custkey % 19 = 1", -8)],
    "NetFractionInstallBurden": [("c_custkey % 6 = 1", -8)],
    "NumRevolvingTradesWBalance": [("c_custkey % 19 = 1", -8)],
    "NumInstallTradesWBalance": [("c_custkey % 23 = 1", -8)],
    "NumBank2NatlTradesWHighUtilization": [("c_custkey % 29 = 1", -8)],
    "PercentTradesWBalance": [("c_custkey % 41 = 1", -8)],
}


#: What is made of the provided tables, by session and folder: written once, read by every query after.
_DERIVED: dict[tuple[str, str, str], tuple] = {}


def derived(spark: SparkSession, sf: str, what: str, make: Callable[[], tuple]) -> tuple:
    """What ``make`` wrote for a folder in this session."""
    name = (spark.sparkContext.applicationId, sf, what)
    if name not in _DERIVED:
        _DERIVED[name] = make()
    return _DERIVED[name]


def usable_applicants(spark: SparkSession, sf: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Raw applicants whose row carries information, and the (feature, code) pairs that occur."""
    return derived(spark, sf, "usable", lambda: usable_rows(raw_applicants(spark, sf), FEATURE_NAMES))


def applicants(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Prepared applicants and their indicators."""
    table, pairs = usable_applicants(spark, sf)
    return encode_sentinels(encode_target(table), FEATURE_NAMES, pairs)


#: Events of a range of keys; runs are numbered within a range, and ranges add up.
EVENT_RANGE = 65_536


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Response log made of events: every event of a user is a run, numbered in either pipeline."""
    return derived(spark, sf, "runs", lambda: (kept(spread(_runs(spark, sf)), "runs"),))[0]


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many files as there are tasks for them, so that all cores work on what reads them."""
    return df.repartition(task_count(df.sparkSession))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    pipe = F.when(F.col("event_id") % 2 == 0, F.lit("structured")).otherwise(F.lit("stock"))
    log = table(spark, sf, "events").withColumns({"pipeline": pipe, "_range": F.floor(F.col("event_id") / EVENT_RANGE)})
    # A user with very many events is numbered by ranges, each of bounded size.
    earlier = Window.partitionBy("pipeline", "user_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = log.groupBy("pipeline", "user_id", "_range").agg(F.count("*").alias("n"))
    starts = counts.select("pipeline", "user_id", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("pipeline", "user_id", "_range").orderBy("event_id"))
    log = log.join(starts, ["pipeline", "user_id", "_range"]).withColumn("_rank", F.col("_start") + own)
    return log.select(
        "pipeline",
        F.col("user_id").alias("case_id"),
        (F.col("_rank") - 1).cast("int").alias("seed"),
        (F.col("user_id") % 2).cast("int").alias("true_label"),
        F.when(F.col("event_type").isin("error", "signup"), F.lit("Bad")).otherwise(F.lit("Good")).alias("label"),
        F.least("value", F.lit(100.0)).alias("confidence"),
        ((F.col("event_type") != "view") & (F.col("user_id") % 13 != 0)).alias("parse_success"),
        (F.col("value") / 10.0).alias("elapsed_seconds"),
        F.concat_ws(" ", "event_type", "props").alias("raw_response"),
    )


def interrupted_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The log as it was left by a batch that broke off: a seventh of the runs is missing."""
    return runs(spark, sf).where((F.col("case_id") + F.col("seed")) % 7 != 0)


def planned_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What the whole batch has: as many runs of a case as it has events."""
    return runs(spark, sf).select("pipeline", "case_id", "seed")


def run_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The planned cases: every user that has events."""
    return table(spark, sf, "events").select(F.col("user_id").alias("case_id")).distinct()


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three scores per usable applicant in steps of 0.01, so that ties and bin edges occur."""
    people = usable_applicants(spark, sf)[0].select("case_id", (F.col(TARGET) == "Bad").cast("int").alias("true_label"))
    scores = [
        F.struct(
            F.lit(m).alias("system"),
            (F.floor(60 * uniform(7, "case_id", F.lit(m)) + 40 * F.col("true_label")) / 100.0).alias("score"),
        )
        for m in MODELS
    ]
    return people.select("case_id", "true_label", F.inline(F.array(*scores))).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def known_cases(spark: SparkSession, sf: str) -> DataFrame:
    """A case table that lacks some orders, for the queries that look for missing cases."""
    return response_cases(spark, sf).where(F.col("case_id") % 50 != 49)


def response_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Values of an order that its response may quote."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.floor("o_totalprice").cast("double").alias("amount"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"),
    )


RESPONSE_VALUES = ["amount", "month", "day"]


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON response per order in sixteen variants, sound and broken, and one in free text."""
    return derived(spark, sf, "responses", lambda: (kept(_responses(spark, sf), "responses"),))[0]


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    labels = sqltext.array(sqltext.text(label) for label, _ in FEATURES.values())
    n = len(FEATURES)
    # Orders are spread before their texts are made, which are many times larger.
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    base = spread(orders).selectExpr(
        "o_orderkey AS k",
        "o_custkey AS applicant_id",
        "CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS true_label",
        "CASE WHEN o_orderstatus = 'F' THEN 'Bad' ELSE 'Good' END AS label",
        "cast(50 + o_orderkey % 50 AS string) AS conf",
        "cast(floor(o_totalprice) AS string) AS amount",
        "cast(month(o_orderdate) AS string) AS month",
        "cast(day(o_orderdate) AS string) AS day",
        f"element_at({labels}, cast(o_orderkey % {n} + 1 AS int)) AS cited",
        f"element_at({labels}, cast((o_orderkey * 7 + 3) % {n} + 1 AS int)) AS also",
    )
    parts = base.selectExpr(
        "*",
        """CASE WHEN k % 16 = 13 THEN '' WHEN k % 5 = 0 THEN '"key_factors": [], '
        ELSE concat('"key_factors": ["The applicant\\'s ', cited, ' is ', amount, '", "', also, '", "seen in month ', month, '"], ') END AS factors""",
        """CASE k % 16 WHEN 6 THEN ' Also 987654.3 and 1,200 were seen.'
        WHEN 7 THEN if(label = 'Good', ' This is high risk.', ' Payment is reliable.')
        WHEN 10 THEN concat(' Stated with ', conf, ' percent, 60+ days in 24.')
        WHEN 11 THEN concat(' Range ', day, '-', month, '.') ELSE '' END AS extra""",
        """CASE k % 16 WHEN 3 THEN '"maybe"' WHEN 9 THEN concat('"  ', lower(label), ' "') ELSE concat('"', label, '"') END AS shown""",
        """CASE k % 16 WHEN 4 THEN '140' WHEN 5 THEN concat('"', conf, '"') WHEN 12 THEN 'null' WHEN 15 THEN 'true' ELSE conf END AS stated""",
    )
    body = parts.selectExpr(
        "*",
        """concat('{"label": ', shown, ', ', factors, '"confidence": ', stated, CASE k % 16 WHEN 8 THEN '' WHEN 14 THEN ', "explanation": ["a list"]'
        ELSE concat(', "explanation": "Value ', amount, ' on day ', day, ' of month ', month, ' within 24 months.', extra, '"') END,
        ', "uncertainty_reason": "none"}') AS body""",
    )
    return body.selectExpr(
        "k AS case_id",
        "applicant_id",
        "'structured' AS pipeline",
        "0 AS seed",
        "true_label",
        """CASE k % 16 WHEN 0 THEN concat('```json\\n', body, '\\n```') WHEN 1 THEN substring(body, 1, 30) WHEN 2 THEN concat('[', body, ']')
        ELSE body END AS raw_response""",
        """CASE k % 8 WHEN 0 THEN concat('**Classification:** **', label, '**\\n**Confidence:** ', conf, '%\\n**Explanation:** Value ', amount)
        WHEN 1 THEN concat('classification: ', lower(label), '\\nconfidence: 140\\nexplanation: none')
        WHEN 2 THEN concat('Classification: unsure Classification: ', label, '\\nConfidence: ', conf, '\\nExplanation: two words')
        WHEN 3 THEN concat('Classification: ', label, '\\nConfidence: high\\nExplanation: two words')
        WHEN 4 THEN concat('Classification: ', label, '\\nConfidence: ', conf, '\\nExplanation:   ')
        WHEN 5 THEN concat(label, ', surely.')
        ELSE concat('Classification: ', label, '\\nConfidence: ', conf, '.5\\nExplanation: first line\\nvalue ', amount) END AS stock_response""",
        "k % 3 = 0 AS parse_success",
    )


def coefficient(method: str, model: str, feature: str) -> float:
    """A coefficient between -0.5 and 0.5 for each explainer, model and feature."""
    return ((FEATURE_NAMES.index(feature) * 7 + METHODS.index(method) * 3 + MODELS.index(model) * 5) % 11 - 5) / 10.0


def feature_means(spark: SparkSession, sf: str) -> dict[str, float]:
    """Means of the prepared features, rounded to six digits, so that they do not depend on the order of summation."""
    means = lambda: applicants(spark, sf)[0].agg(*[F.expr(f"round(avg({f}), 6) AS {f}") for f in FEATURE_NAMES]).first().asDict()
    return derived(spark, sf, "means", lambda: (means(),))[0]


def reference_tops(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Top features per (method, model, case), taken from one wide row per applicant without a shuffle."""
    prepared, _ = applicants(spark, sf)
    means = feature_means(spark, sf)
    items = []
    for method in METHODS:
        for model in MODELS:
            weights = linear_weights({f: coefficient(method, model, f) for f in FEATURE_NAMES}, means)
            top = top_features_of_row({f: f"round({w}, 6)" for f, w in weights.items()}, k)
            items.append(F.struct(F.lit(method).alias("method"), F.lit(model).alias("model"), top.alias("top_features")))
    return prepared.select("case_id", F.inline(F.array(*items)))


#: A forest of two trees, as rows of a node table, over three features, and two background rows for them.
RULE_FEATURES = ["ExternalRiskEstimate", "NumTotalTrades", "PercentTradesNeverDelq"]
RULE_NODES = [
    # tree, node, feature, cut, default_left, left, right, value
    (0, 0, 0, 66.0, True, 1, 2, 0.0),
    (0, 1, 1, 9.0, False, 3, 4, 0.0),
    (0, 2, 2, 70.0, False, 5, 6, 0.0),
    (0, 3, -1, 0.0, False, -1, -1, 0.9),
    (0, 4, 0, 55.0, True, 7, 8, 0.0),
    (0, 5, -1, 0.0, False, -1, -1, 0.4),
    (0, 6, -1, 0.0, False, -1, -1, 0.1),
    (0, 7, -1, 0.0, False, -1, -1, 0.8),
    (0, 8, -1, 0.0, False, -1, -1, 0.5),
    (1, 0, 1, 11.0, True, 1, 2, 0.0),
    (1, 1, -1, 0.0, False, -1, -1, 0.3),
    (1, 2, 0, 80.0, False, 3, 4, 0.0),
    (1, 3, -1, 0.0, False, -1, -1, 0.6),
    (1, 4, -1, 0.0, False, -1, -1, 0.2),
]
RULE_BACKGROUND = [[60.0, 12.0, 80.0], [85.0, 5.0, 50.0]]


def rule_forest() -> Ensemble:
    nodes = pd.DataFrame(RULE_NODES, columns=["tree", "node", "feature", "cut", "default_left", "left", "right", "value"])
    return ensemble_of(nodes, RULE_FEATURES, 0.5, 0.0, "identity")


#: Features and coefficients of a linear score, for the surrogate that gives them back.
SCORED = {"ExternalRiskEstimate": -0.01, "NumTotalTrades": 0.02, "MSinceOldestTradeOpen": -0.005, "NetFractionRevolvingBurden": 0.03}


def linear_score() -> str:
    return " + ".join(["0.5D", *[f"({c!r}D * {f})" for f, c in SCORED.items()]])

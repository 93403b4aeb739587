"""Operators against brute force on small and skewed tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetally.functions.draws import gaussian_sql
from casetally.functions.profiles import reworded_profile_text, sentence
from casetally.functions.prompts import glossary, structured_prompt, structured_system
from casetally.functions.pvalues import binomial_p, chi2_p
from casetally.operators import agreement, grounding, metrics, ordering, paired, prepare, robustness, runs, sampling, votes
from casetally.plans import reports
from casetally.schema import FEATURE_NAMES, FEATURES, PERTURBATIONS, RAW_COLUMNS, TARGET


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- order statistics


def values(kind, n=900, seed=5):
    rng = random.Random(seed)
    if kind == "hot":  # one value holds a third of the rows
        return [0.5 if i % 3 == 0 else rng.random() for i in range(n)]
    if kind == "crowded":  # distinct values that agree to many digits
        return [0.7 + rng.random() * 1e-9 for _ in range(n)]
    if kind == "signs":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(n)] + [0.0, -0.0, 1.0, 2.0, 4.0]
    return [float(rng.randint(0, 5)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["hot", "crowded", "signs", "few"])
def test_describe_is_exact(spark, kind):
    xs = values(kind)
    row = ordering.describe(frame(spark, [("a", x) for x in xs] + [("b", 1.0)], "g string, x double"), ["g"], "x").where("g = 'a'").first()
    want = np.quantile(xs, [0.25, 0.5, 0.75])
    assert row["count"] == len(xs) and row["min"] == min(xs) and row["max"] == max(xs)
    assert np.allclose([row["p25"], row["p50"], row["p75"]], want, rtol=1e-12, atol=0)
    assert math.isclose(row["mean"], np.mean(xs), rel_tol=1e-9, abs_tol=1e-12) and math.isclose(row["std"], np.std(xs, ddof=1), rel_tol=1e-6)


def test_describe_of_missing_values(spark):
    rows = [("a", None), ("a", float("nan")), ("b", 2.0), ("b", None), (None, 3.0)]
    got = {r.g: r for r in ordering.describe(frame(spark, rows, "g string, x double"), ["g"], "x").collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["p50"]) == (0, None, None)
    assert (got["b"]["count"], got["b"]["p50"], got["b"]["std"]) == (1, 2.0, None)
    assert got[None]["p50"] == 3.0


def test_range_numbers_never_fall(spark):
    xs = sorted(set(values("signs", 3000) + [2.0**k for k in range(-60, 60)] + [math.nextafter(2.0**k, 0) for k in range(-60, 60)]))
    got = [r.k for r in frame(spark, [(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", F.expr(ordering.range_number("x")).alias("k")).orderBy("i").collect()]
    assert got == sorted(got)


# ---------------------------------------------------------------- metrics


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, ap, seen = sum(y for y, _ in rows), 0.0, 0.0
    for s in sorted({s for _, s in rows}, reverse=True):
        taken = [y for y, x in rows if x >= s]
        recall = sum(taken) / total
        ap, seen = ap + (recall - seen) * sum(taken) / len(taken), recall
    return ap


@pytest.mark.parametrize("kind", ["hot", "crowded", "few"])
def test_ranking_matches_pair_counting(spark, kind):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.4), x) for x in values(kind, 300)]
    row = metrics.ranking(frame(spark, [("m", *r) for r in rows], "system string, true_label int, score double"), ["system"]).first()
    assert math.isclose(row.roc_auc, brute_auc(rows), rel_tol=1e-12) and math.isclose(row.average_precision, brute_ap(rows), rel_tol=1e-12)


def test_classification_with_empty_denominators(spark):
    row = metrics.classification(frame(spark, [("m", 0, 0)], "system string, true_label int, pred int"), ["system"]).first()
    assert (row.tn, row.accuracy, row.precision, row.recall, row.f1) == (1, 1.0, 0.0, 0.0, 0.0)


def test_calibration_bins(spark):
    rows = [("m", 1, 0.7), ("m", 0, 0.1), ("m", 1, 1.0), ("m", 0, 0.0), ("m", 1, 0.25), ("m", 0, 0.35)]
    df = frame(spark, rows, "system string, true_label int, score double")
    # 0.7 lies below the edge 0.7000000000000001; 0.1 opens the second bin but closes the first of the curve.
    curve = {r.bin: r.n_cases for r in metrics.calibration_curve(df, ["system"]).collect()}
    assert curve == {6: 1, 0: 2, 9: 1, 2: 1, 3: 1}
    edges = np.linspace(0, 1, 11)
    y, p = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    bins = np.digitize(p, edges[1:-1])
    ece = sum((bins == b).mean() * abs(y[bins == b].mean() - p[bins == b].mean()) for b in set(bins))
    row = metrics.calibration(df, ["system"]).first()
    assert math.isclose(row.ece, ece) and math.isclose(row.brier_score, ((p - y) ** 2).mean()) and 0 <= row.ece <= 1


# ---------------------------------------------------------------- votes


LOG = "pipeline string, case_id string, seed int, true_label int, label string, confidence double, parse_success boolean, raw_response string"


def log_of(spark, rows):
    return frame(spark, [("p", *r, f"{r[0]}-{r[1]}") for r in rows], LOG)


def test_votes_ties_and_failures(spark):
    rows = [
        ("tie", 0, 1, None, None, False), ("tie", 1, 1, "Bad", 80.0, True), ("tie", 2, 1, "Good", 60.0, True),
        ("none", 0, 0, "Good", None, False), ("none", 1, 0, None, None, None),
        ("most", 0, 0, "Bad", 90.0, True), ("most", 1, 0, "Good", 70.0, True), ("most", 2, 0, "Good", 50.0, True), ("most", 3, 0, None, None, False),
    ]
    got = {r.case_id: r for r in votes.case_summary(log_of(spark, rows)).collect()}
    assert (got["tie"].vote, got["none"].vote, got["most"].vote) == ("Bad", None, "Good")
    assert (got["tie"].consistency, got["none"].consistency, got["most"].consistency) == (1 / 3, 0.0, 0.5)
    assert got["none"].never_parsed and got["most"].mean_confidence == 70.0
    assert math.isclose(got["most"].prob_bad, (0.9 + 0.3 + 0.5) / 3) and not got["most"].truth_differs
    split = votes.low_consistency_split(votes.case_summary(log_of(spark, rows))).first()
    assert (split.n_low, split.n_never_parsed, split.n_split) == (3, 1, 2)


def test_one_case_with_a_third_of_all_runs(spark):
    rows = [("hot", i, 1, "Bad" if i % 3 else "Good", 50.0, True) for i in range(3000)] + [(f"c{i}", 0, 0, "Good", 90.0, True) for i in range(6000)]
    cases = votes.case_summary(log_of(spark, rows))
    hot = cases.where("case_id = 'hot'").first()
    assert (hot.n_runs, hot.n_bad, hot.vote) == (3000, 2000, "Bad") and cases.count() == 6001


def test_completeness_takes_the_smaller_mode(spark):
    rows = [("a", 0, 1, "Bad", 1.0, True), ("b", 0, 1, "Bad", 1.0, True), ("b", 1, 1, "Bad", 1.0, True)]
    planned = frame(spark, [("a",), ("b",), ("c",)], "case_id string")
    row = votes.completeness(votes.case_summary(log_of(spark, rows)), planned).first()
    assert (row.n_repeats, row.n_expected, row.n_records, row.complete) == (1, 3, 3, False)


# ---------------------------------------------------------------- paired tests


# Counts, statistic and p-value of published comparisons.
PUBLISHED = [
    (14, 27, 3.5121951219512195, 0.06091869077971672),
    (7, 8, 7.0, 1.0),
    (7, 7, 7.0, 1.0),
    (13, 11, 11.0, 0.8388197422027588),
    (28, 16, 2.75, 0.09725442843900337),
    (30, 17, 3.0638297872340425, 0.08005278235757977),
    (28, 13, 4.780487804878049, 0.028783965875738372),
]


def test_paired_tests_reproduce_published_values(spark):
    counts = frame(spark, [(f"{i}", a, b) for i, (a, b, _, _) in enumerate(PUBLISHED)], "comparison string, n01 long, n10 long")
    got = {int(r.comparison): r for r in paired.mcnemar(counts).collect()}
    for i, (_, _, statistic, p) in enumerate(PUBLISHED):
        assert math.isclose(got[i].statistic, statistic) and math.isclose(got[i].p_value, p, rel_tol=1e-12)
    assert {r.test_type for r in got.values()} == {"exact_binomial", "chi2_continuity_corrected"}


def test_p_values_match_the_closed_forms(spark):
    xs = [0.0, 1e-6, 0.3, 1.0, 3.84, 7.9, 8.0, 8.1, 20.0, 100.0, 600.0]
    for r in frame(spark, [(x,) for x in xs], "x double").select("x", F.expr(chi2_p("x")).alias("p")).collect():
        assert math.isclose(r.p, math.erfc(math.sqrt(r.x / 2)), rel_tol=1e-11)
    pairs = [(k, n) for n in range(25) for k in range(n // 2 + 1)]
    for r in frame(spark, pairs, "k long, n long").select("k", "n", F.expr(binomial_p("k", "n")).alias("p")).collect():
        assert math.isclose(r.p, min(1.0, 2 * sum(math.comb(r.n, i) for i in range(r.k + 1)) / 2**r.n), rel_tol=1e-14)


def test_holm_reproduces_published_values(spark):
    tests = frame(spark, [(f"{i}", row[3]) for i, row in enumerate(PUBLISHED[:4])], "comparison string, p_value double")
    got = {r.comparison: r for r in paired.holm(tests).collect()}
    assert math.isclose(got["0"].p_value_holm, 0.24367476311886688) and [got[k].p_value_holm for k in "123"] == [1.0, 1.0, 1.0]
    assert not any(r.significant for r in got.values())


def test_holm_is_monotone(spark):
    ps = [0.001, 0.04, 0.03, 0.2, 0.011, 0.9]
    got = paired.holm(frame(spark, [(f"{i}", p) for i, p in enumerate(ps)], "comparison string, p_value double")).orderBy("p_value").collect()
    corrected = [r.p_value_holm for r in got]
    assert corrected == sorted(corrected) and all(r.p_value_holm >= r.p_value for r in got)


def test_alignment_drops_incomplete_cases(spark):
    truth = frame(spark, [("a", "Bad"), ("b", "Good"), ("c", "Bad")], "case_id string, label string")
    predictions = frame(spark, [("x", "a", "Bad"), ("y", "a", "Good"), ("x", "b", "Good"), ("y", "d", "Bad")], "system string, case_id string, label string")
    aligned = paired.align(truth, predictions, ["x", "y"])
    row = paired.alignment_counts(aligned, ["x", "y"]).first()
    assert (row.n_cases, row.n_common, row.n_dropped) == (4, 1, 3)
    counts = paired.discordance(paired.common_cases(aligned), [("x", "y")]).first()
    assert (counts.n00, counts.n01, counts.n10, counts.n11) == (0, 0, 1, 0)


# ---------------------------------------------------------------- preparation


def test_prepare(spark):
    rows = [("r0", 1.0, -9.0, 5, "Good"), ("r1", -8.0, float("nan"), -7, "Bad"), ("r2", -9.0, -9.0, -9, "Bad"), ("r3", None, 2.0, 3, "Good")]
    raw = frame(spark, rows, f"k string, a double, b double, c int, {TARGET} string").withColumn("Unnamed: 0", F.lit(1)).withColumn("ID", F.lit(1))
    table, features, indicators = prepare.prepare(raw, keys=["k"])
    assert features == ["a", "b", "c"]
    assert indicators == ["a_missing_no_usable_trades_or_inquiries", "b_missing_no_bureau_record", "c_missing_condition_not_met"]
    got = {r.k: r for r in table.collect()}
    assert set(got) == {"r0", "r1", "r3"}
    assert (got["r1"].a, got["r1"].b, got["r1"].c, got["r1"][TARGET]) == (None, None, None, 1)
    assert (got["r0"][indicators[1]], got["r3"][indicators[0]]) == (1, 0)
    flags = {r.k: r.n_sentinel_flags for r in prepare.sentinel_flags(table, indicators).collect()}
    assert flags == {"r0": 1, "r1": 2, "r3": 0}


@pytest.mark.parametrize("rows,schema", [([("Good",), ("Fair",)], "string"), ([(0,), (2,)], "int"), ([(None,)], "string")])
def test_unexpected_target_fails(spark, rows, schema):
    with pytest.raises(Exception, match="unexpected value"):
        prepare.encode_target(frame(spark, rows, f"{TARGET} {schema}")).collect()


def test_numeric_target_stays(spark):
    assert [r[0] for r in prepare.encode_target(frame(spark, [(0,), (1,)], f"{TARGET} int")).collect()] == [0, 1]


def test_rename_needs_all_columns(spark):
    with pytest.raises(ValueError, match="estimate_of_risk"):
        prepare.rename_columns(frame(spark, [(1,)], "x int"))
    names = list(RAW_COLUMNS)
    renamed = prepare.rename_columns(frame(spark, [tuple(range(len(names)))], ", ".join(f"{n} int" for n in names)))
    assert set(renamed.columns) == set(RAW_COLUMNS.values())


def test_special_codes_and_polarity(spark):
    raw = frame(spark, [(-9.0, 1), (-9.0, 0), (80.0, 1), (60.0, 0), (-8.0, 0)], f"ExternalRiskEstimate double, {TARGET} int")
    assert [(r.code, r.n_rows) for r in prepare.special_code_counts(raw, ["ExternalRiskEstimate"]).collect()] == [(-9, 2), (-8, 1)]
    assert prepare.target_polarity(raw).first().asDict() == {"mean_good": 60.0, "mean_bad": 80.0, "swapped": True}
    shape = prepare.inspect_table(raw, ["ExternalRiskEstimate"])
    assert {r[TARGET]: r.n_rows for r in shape["target"].collect()} == {0: 3, 1: 2} and shape["types"].first()["count"] == 1


# ---------------------------------------------------------------- sampling


def population(spark, n=9871, bad=0.5202):
    # The share of class 1 is one third larger in the first keys, so key order and class are not independent.
    return spark.range(n).select(F.col("id").alias("case_id"), (F.col("id") < int(n * bad)).cast("int").alias(TARGET))


def test_split_sizes_are_exact(spark):
    df = sampling.stratified_split(population(spark))
    sizes = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes == {"train": 6909, "val": 1481, "test": 1481}
    shares = {r.split: r.s for r in df.groupBy("split").agg(F.avg(TARGET).alias("s")).collect()}
    assert max(shares.values()) - min(shares.values()) < 0.001
    again = sampling.stratified_split(population(spark).repartition(3)).select("case_id", "split")
    assert again.exceptAll(df.select("case_id", "split")).count() == 0


def test_split_is_the_hash_order(spark):
    from hashlib import md5

    rows = sampling.stratified_split(population(spark, 500)).collect()
    for y in (0, 1):
        ordered = sorted((r for r in rows if r[TARGET] == y), key=lambda r: md5(f"42|{r.case_id}".encode()).hexdigest())
        parts = [r.split for r in ordered]
        assert parts == sorted(parts, key=["test", "val", "train"].index)


def test_folds_are_balanced(spark):
    df = sampling.stratified_folds(population(spark, 1003))
    sizes = {}
    for r in df.groupBy(TARGET, "fold").count().collect():
        sizes.setdefault(r[TARGET], []).append(r["count"])
    assert all(len(s) == 5 and max(s) - min(s) <= 1 for s in sizes.values())


def test_subset_takes_small_classes_whole(spark):
    rows = [(i, int(i < 4), (i % 10) / 10) for i in range(40)]
    subset = sampling.select_subset(frame(spark, rows, f"case_id long, {TARGET} int, score double"), "score", 10)
    got = subset.collect()
    assert sorted(r.case_id for r in got) == [f"case_{i:04d}" for i in range(len(got))]
    assert len({r.original_case_id for r in got}) == len(got)
    by_class = {y: sum(r[TARGET] == y for r in got) for y in (0, 1)}
    assert by_class == {0: 10, 1: 4}


def test_sample_size(spark):
    assert sampling.sample_rows(population(spark, 50), 20).count() == 20
    assert sampling.sample_rows(population(spark, 5), 20).count() == 5
    assert [r.case_id for r in sampling.shuffled(population(spark, 50)).limit(3).collect()] == [r.case_id for r in sampling.sample_rows(population(spark, 50), 3).orderBy(F.md5(F.concat_ws("|", F.lit("42"), "case_id"))).collect()]


def test_perturbation_stays_in_bounds(spark):
    rows = [(i, *[[0.0, 50.0, 100.0, None][(i + j) % 4] for j in range(6)]) for i in range(400)]
    names = list(PERTURBATIONS)
    df = frame(spark, rows, "case_id int, " + ", ".join(f"{n} double" for n in names))
    moved = {r.case_id: r for r in sampling.perturb(df).collect()}
    for r in df.collect():
        for n, m in PERTURBATIONS.items():
            old, new = r[n], moved[r.case_id][n]
            assert (old is None) == (new is None)
            if old is not None:
                assert abs(new - old) <= m + 0.051 and new >= 0 and (n == "ExternalRiskEstimate" or new <= 100) and new == round(new, 1)
    with pytest.raises(ValueError, match="PercentTradesNeverDelq"):
        sampling.perturb(df.drop("PercentTradesNeverDelq"))


def test_magnitude_skips_missing_values(spark):
    old = frame(spark, [("a", 1.0, None), ("b", 1.0, 2.0)], "case_id string, ExternalRiskEstimate double, PercentInstallTrades double")
    new = frame(spark, [("a", 3.5, 9.0), ("c", 1.0, 2.0)], "case_id string, ExternalRiskEstimate double, PercentInstallTrades double")
    assert [tuple(r) for r in robustness.perturbation_magnitude(old, new).collect()] == [("a", 2.5)]


def test_gaussian_draws(spark):
    row = spark.range(20000).select(F.expr(gaussian_sql(1, "id")).alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s"), F.min("z").alias("low")).first()
    assert abs(row.m) < 0.03 and abs(row.s - 1) < 0.03 and row.low < -3


# ---------------------------------------------------------------- texts


def applicant(spark, **changes):
    base = {f: 5.0 for f in FEATURE_NAMES}
    base.update(changes)
    return frame(spark, [("x", *base.values(), int("MSinceMostRecentDelq" in changes and changes["MSinceMostRecentDelq"] is None))],
                 "case_id string, " + ", ".join(f"{f} double" for f in base) + ", MSinceMostRecentDelq_missing_condition_not_met int")


INDICATORS = ["MSinceMostRecentDelq_missing_condition_not_met"]


@pytest.mark.parametrize(
    "feature,value,text",
    [
        ("NumTotalTrades", 12.0, "The applicant's total number of trades is 12."),
        ("NumTotalTrades", 12.5, "The applicant's total number of trades is 12.5."),
        ("NumTotalTrades", None, "For total number of trades, no data is available for this applicant."),
        ("AverageMInFile", 7.0, "The applicant's average number of months trade lines have been on file is 7 months."),
        ("PercentInstallTrades", 32.25, "The applicant's percentage of trades that are installment trades is 32.2%."),
        ("MaxDelqEver", 6.0, "The applicant's worst delinquency/public-record status ever recorded is: 30 days delinquent."),
        ("MaxDelqEver", 1.0, "The applicant's worst delinquency/public-record status ever recorded is coded 1, which does not match any documented category for this field."),
        ("MSinceMostRecentDelq", None, "For months since the most recent delinquency, this measure is not applicable (the relevant condition was not met, e.g. no inquiries or no delinquencies on record)."),
    ],
)
def test_sentences(spark, feature, value, text):
    assert applicant(spark, **{feature: value}).select(F.expr(sentence(feature, INDICATORS))).first()[0] == text


def test_rewording_keeps_all_facts(spark):
    df = applicant(spark)
    one = df.select(reworded_profile_text(INDICATORS)).first()[0]
    assert one == df.select(reworded_profile_text(INDICATORS)).first()[0]
    lowered = one.lower()
    assert all(label.lower() in lowered for label, _ in FEATURES.values())
    other = df.withColumn("case_id", F.lit("y")).select(reworded_profile_text(INDICATORS)).first()[0]
    assert one != other


def test_prompts(spark):
    examples = [{"profile_text": "A text.", "ideal_response": {"label": "Good", "confidence": 90}}]
    system = structured_system(examples)
    assert system.endswith('Applicant profile:\nA text.\n\nResponse:\n{\n  "label": "Good",\n  "confidence": 90\n}')
    assert glossary() in system and len(glossary().splitlines()) == len(FEATURES) + 1
    _, user = structured_prompt(F.lit("Text."), examples)
    assert spark.range(1).select(user).first()[0] == "Now classify this applicant:\n\nText."


# ---------------------------------------------------------------- agreement


def test_longest_label_wins(spark):
    factors = [["Number of credit inquiries in the last 6 months, excluding the last 7 days: 3", "number of credit inquiries in the last 6 months", "weather"], None, []]
    got = agreement.map_factors(frame(spark, [(i, f) for i, f in enumerate(factors)], "i int, key_factors array<string>")).orderBy("i").collect()
    assert got[0].cited_features == ["NumInqLast6M", "NumInqLast6Mexcl7days"] and (got[0].n_factors, got[0].n_unmapped) == (3, 1)
    assert [(r.cited_features, r.n_factors) for r in got[1:]] == [([], 0), ([], 0)]


def test_precision(spark):
    df = frame(spark, [(["a", "b"], ["b", "c"]), ([], ["b"]), (["a"], None)], "c array<string>, r array<string>")
    assert [r[0] for r in df.select(agreement.grounding_precision(F.col("c"), F.col("r"))).collect()] == [0.5, None, None]


def test_top_features(spark):
    rows = [("x", f, w) for f, w in [("a", 1.0), ("b", -3.0), ("c", 2.0), ("d", 2.0)]]
    top = agreement.top_features(frame(spark, rows, "case_id string, feature string, weight double"), ["case_id"], 3).first()
    wide = frame(spark, [(1.0, -3.0, 2.0, 2.0)], "a double, b double, c double, d double").select(agreement.top_features_of_row({f: f for f in "abcd"}, 3)).first()[0]
    assert top.top_features == wide == ["b", "c", "d"]


def test_distances(spark):
    df = frame(spark, [("x", False, [7.0, 100.0], 5.0, None), ("y", True, [], 1.0, 1.0), ("z", False, [3.0], None, None)],
               "case_id string, explanation_grounded boolean, ungrounded_numbers array<double>, a double, b double")
    got = grounding.ungrounded_distances(df, ["a", "b"], ["case_id"]).collect()
    assert sorted((r.case_id, r.number, r.distance) for r in got) == [("x", 7.0, 2.0), ("x", 100.0, 95.0)]


# ---------------------------------------------------------------- plans and reports


def test_resuming_adds_nothing(spark):
    cases = frame(spark, [("a",), ("b",)], "case_id string")
    planned = runs.plan_runs(cases, ["stock", "structured"], 5)
    assert planned.count() == 20 and runs.remaining(planned, None).count() == 20
    done = planned.where("seed < 3")
    assert runs.remaining(planned, done).count() == 8
    assert runs.remaining(planned, done.unionByName(runs.remaining(planned, done))).count() == 0
    assert {tuple(r) for r in runs.progress(planned, done).collect()} == {("stock", 10, 6, 4), ("structured", 10, 6, 4)}


def test_run_report(spark, small):
    from casetally.plans import fixtures

    report = reports.run_analysis(fixtures.runs(spark, small), fixtures.run_cases(spark, small))
    assert {"parse_rates", "labels", "confidence", "consistency", "stability", "confusion", "accuracy", "completeness", "false_negatives"} <= set(report)
    assert all(table.count() > 0 for table in report.values())


def test_robustness_report(spark):
    before = log_of(spark, [("a", 0, 1, "Good", 80.0, True), ("b", 0, 1, "Bad", 80.0, True), ("c", 0, 1, "Bad", 80.0, True)])
    after = log_of(spark, [("a", 0, 1, "Bad", 70.0, True), ("b", 0, 1, "Bad", 85.0, True), ("c", 0, 1, None, None, False)])
    cases = frame(spark, [("a", 1.0), ("b", 2.0)], "case_id string, ExternalRiskEstimate double")
    report = reports.robustness_report(before, after, cases, cases.withColumn("ExternalRiskEstimate", F.col("ExternalRiskEstimate") + 2))
    flips = report["flips"].first()
    assert (flips.n_cases, flips.n_flipped, flips.flip_rate, flips.mean_abs_delta, flips.max_abs_delta) == (2, 1, 0.5, 7.5, 10.0)
    assert [tuple(r) for r in report["directions"].collect()] == [("Good -> Bad", 1)]
    assert [r.case_id for r in report["without_vote"].collect()] == ["c"]
    assert {r.flipped: r.mean for r in report["magnitude"].collect()} == {True: 2.0, False: 2.0}


def test_grounding_diagnosis(spark, small):
    from casetally.plans import catalog, fixtures

    log = catalog.parsed_responses(spark, small)
    cases = fixtures.response_cases(spark, small).withColumn("flag", (F.col("case_id") % 2).cast("int"))
    scores = cases.select("case_id", (F.col("day") / 31).alias("score"))
    report = reports.grounding_diagnosis(log, cases, fixtures.RESPONSE_VALUES, ["flag"], scores)
    assert {r.always_fails for r in report["sentinels"].collect()} == {True, False}
    assert report["distances"].first()["count"] > 0 and report["borderline"].count() == 2 and report["examples"].count() == 3


def test_agreement_report(spark):
    log = frame(spark, [("a", 0, 1, "Bad", True, ["total number of trades", "x"]), ("b", 0, 1, "Good", True, ["number of satisfactory trades"]), ("c", 0, 0, "Good", False, None)],
                "case_id string, seed int, true_label int, label string, parse_success boolean, key_factors array<string>")
    tops = frame(spark, [("shap", "m", "a", ["NumTotalTrades"]), ("lime", "m", "a", ["AverageMInFile"]), ("shap", "m", "b", ["AverageMInFile"])],
                 "method string, model string, case_id string, top_features array<string>")
    report = reports.explanation_agreement(log, tops, [("shap", "m"), ("lime", "m")])
    assert {r.reference: (r.mean_precision, r.n_valid) for r in report["summary"].collect()} == {"shap_m": (0.5, 2), "lime_m": (0.0, 1)}
    assert report["unmapped"].first().unmapped_rate == pytest.approx(1 / 3)
    assert report["lowest"].first().case_id == "b"
    assert json.loads(report["by_correctness"].where("correct").toJSON().first())["precision_shap_m"] == 1.0


def test_a_parsed_run_without_a_label_has_no_vote(spark):
    rows = [(1, 0, None, 80.0), (1, 1, "good", 80.0), (2, 0, "Bad", 80.0), (2, 1, None, 80.0), (3, 0, "Good", 60.0)]
    log = spark.createDataFrame(rows, "case_id int, seed int, label string, confidence double").selectExpr("*", "true AS parse_success", "1 AS true_label")
    cases = {r.case_id: r for r in votes.case_summary(log, []).collect()}
    assert [(cases[i].vote, cases[i].n_unlabelled) for i in (1, 2, 3)] == [(None, 2), ("Bad", 1), ("Good", 0)]


def test_crowded_scores_are_spread_and_ranked_exactly(spark):
    rows = spark.range(1_000_000).selectExpr("1D - (id + 1) * 1e-10 AS s", "cast(id % 3 = 0 AS int) AS n")
    cut = rows.selectExpr(ordering.range_number("s") + " AS r", ordering.part_number("s") + " AS p")
    assert cut.groupBy("r", "p").count().agg(F.max("count")).first()[0] < 2_000
    totals = ordering.running_totals(rows, [], "s", ["n"]).where("abs(s - (1D - 500001e-10)) < 1e-14").first()
    assert totals.cum_n == sum(1 for i in range(500_000, 1_000_000) if i % 3 == 0) and totals.all_n == 333_334
    signed = spark.createDataFrame([(-3.00001,), (-3.0,), (-0.0,), (0.1,), (0.1000001,), (2.0,)], "s double").selectExpr("s", "1 AS n")
    assert [r.cum_n for r in ordering.running_totals(signed, [], "s", ["n"]).orderBy("s").collect()] == [1, 2, 3, 4, 5, 6]


def test_summary_and_preparation_evaluate_their_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, ["a", "b"][i % 2], i % 3 % 2, i % 5 % 2, i % 7 / 7) for i in range(200)]
    df = spark.createDataFrame(rows, "case_id long, system string, true_label int, pred int, score double")
    watched = df.mapInArrow(watch, df.schema)
    assert metrics.summary(watched, ["system"]).count() == 2 and seen.value == 200
    raw = spark.createDataFrame([(i, float(i % 9 - 8), 5.0, "Bad" if i % 2 else "Good") for i in range(100)], f"case_id long, x double, y double, {TARGET} string")
    table, features, indicators = prepare.prepare(raw.mapInArrow(watch, raw.schema), keys=["case_id"])
    assert table.count() == 100 and seen.value == 300
    assert features == ["x", "y"] and len(indicators) == 2


def test_generators_may_take_whole_batches(spark):
    class Many:
        def many(self, prompts, seeds, system_prompt, max_new_tokens):
            return [f"{system_prompt} {p} {s} {max_new_tokens}" for p, s in zip(prompts, seeds, strict=True)]

    requests = spark.createDataFrame([(f"c{i}", i, f"p{i}") for i in range(5)], "case_id string, seed int, user_prompt string")
    got = {r.case_id: r for r in runs.generate(requests, Many, "sys", 9).collect()}
    assert {c: r.raw_response for c, r in got.items()} == {f"c{i}": f"sys p{i} {i} 9" for i in range(5)}
    assert all(r.elapsed_seconds >= 0 for r in got.values())

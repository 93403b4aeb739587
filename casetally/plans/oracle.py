"""The same queries in plain SQL, to be run by another engine on the same tables."""

from __future__ import annotations

from casetally.functions.profiles import (
    GENERAL_WORDINGS,
    LOW_UNCERTAINTY,
    MODERATE_UNCERTAINTY,
    NO_DATA,
    PERCENT_WORDINGS,
    SENTINEL_WORDINGS,
    STATUS_WORDINGS,
    TENSION_NOTE,
    UNMAPPED_STATUS,
    UNMAPPED_STATUS_REWORDED,
)
from casetally.functions.prompts import STOCK_USER, STRUCTURED_USER
from casetally.plans.fixtures import METHODS, MODELS, SENTINELS, coefficient
from casetally.plans.reports import PRIMARY_PAIRS, SECONDARY_PAIRS
from casetally.schema import (
    CONTRADICTIONS,
    CORE_FACTORS,
    EXPLANATION_CLOSING,
    EXPLANATION_OPENING,
    FEATURE_NAMES,
    FEATURES,
    NUMBER_PATTERN,
    PERTURBATIONS,
    PROFILE_ORDER,
    SENTINEL_PHRASES,
    SPECIAL_CODES,
    STATUS_CODES,
    STOCK_CONFIDENCE,
    TARGET,
    indicator_name,
    vocabulary_numbers,
)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT)"


INDICATORS = [(f, c) for f in FEATURE_NAMES for c in SPECIAL_CODES if c in [code for _, code in SENTINELS.get(f, [])]]
PAIRS = PRIMARY_PAIRS + SECONDARY_PAIRS
SYSTEMS = ["stock", "structured", *MODELS]
CONDITIONS = [(method, model) for model in MODELS for method in METHODS]

# ---------------------------------------------------------------- common tables

CTES: dict[str, str] = {}

CTES["runs"] = """
SELECT pipeline, case_id, seed, true_label, label, confidence, parse_success, elapsed_seconds, raw_response FROM (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'structured' ELSE 'stock' END AS pipeline, user_id AS case_id,
    CAST(row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY event_id) - 1 AS INTEGER) AS seed,
    CAST(user_id % 2 AS INTEGER) AS true_label,
    CASE WHEN event_type IN ('error', 'signup') THEN 'Bad' ELSE 'Good' END AS label,
    least(value, 100.0) AS confidence,
    event_type <> 'view' AND user_id % 13 <> 0 AS parse_success,
    value / 10.0 AS elapsed_seconds,
    event_type || ' ' || props AS raw_response
  FROM events)
"""

CTES["interrupted"] = "SELECT * FROM runs WHERE (case_id + seed) % 7 <> 0"

CTES["votes"] = """
SELECT pipeline, case_id, label, count(*) AS n, min(seed) AS first_seed FROM runs WHERE parse_success GROUP BY ALL
"""

CTES["cases"] = """
SELECT r.*, v.vote, coalesce(v.top, 0) / r.n_runs AS consistency, r.n_parsed = 0 AS never_parsed,
  CASE r.true_label WHEN 1 THEN 'Bad' WHEN 0 THEN 'Good' END AS true_name
FROM (SELECT pipeline, case_id, count(*) AS n_runs, count(*) FILTER (WHERE parse_success) AS n_parsed,
    avg(confidence) FILTER (WHERE parse_success) AS mean_confidence,
    avg(CASE WHEN label = 'Bad' THEN confidence / 100.0 ELSE 1.0 - confidence / 100.0 END) FILTER (WHERE parse_success) AS prob_bad,
    min(true_label) AS true_label
  FROM runs GROUP BY ALL) r
LEFT JOIN (SELECT pipeline, case_id, first(label ORDER BY n DESC, first_seed) AS vote, max(n) AS top FROM votes GROUP BY ALL) v
  USING (pipeline, case_id)
"""

CTES["per_order"] = """
SELECT l_orderkey, count(*) AS items, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
  max(CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END) AS last_return
FROM lineitem GROUP BY l_orderkey
"""

CTES["aged"] = """
SELECT o.*, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS age FROM orders o
"""

CTES["per_customer"] = """
SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS n_part, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
  max(age) AS oldest, min(age) AS latest, CAST(sum(age) AS BIGINT) AS ages, count(*) FILTER (WHERE age <= 360) AS n_year,
  count(*) FILTER (WHERE age <= 180) AS n_half, count(*) FILTER (WHERE age <= 180 AND age > 7) AS n_half_late,
  min(age) FILTER (WHERE age > 7) AS late, CAST(coalesce(sum(items), 0) AS BIGINT) AS items, CAST(coalesce(sum(returned), 0) AS BIGINT) AS returned,
  CAST(coalesce(sum(discount), 0) AS BIGINT) AS discount, CAST(coalesce(sum(tax), 0) AS BIGINT) AS tax,
  date_diff('day', max(last_return), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS since_return
FROM aged LEFT JOIN per_order ON o_orderkey = l_orderkey GROUP BY o_custkey
"""

_PLAIN = {
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


def _coded(feature: str) -> str:
    planted = " ".join(f"WHEN {condition} THEN {code}" for condition, code in SENTINELS.get(feature, []))
    return f"CAST(CASE WHEN c_custkey % 17 = 0 THEN -9 {planted} ELSE coalesce({_PLAIN[feature]}, -8) END AS DOUBLE) AS {feature}"


CTES["raw_applicants"] = f"""
SELECT c_custkey AS case_id, {', '.join(map(_coded, FEATURE_NAMES))},
  CASE WHEN c_custkey % 3 = 0 OR coalesce(100 * returned / nullif(items, 0) > 33, false) THEN 'Bad' ELSE 'Good' END AS {TARGET}
FROM customer LEFT JOIN per_customer ON c_custkey = o_custkey
"""

CTES["kept_applicants"] = f"SELECT * FROM raw_applicants WHERE greatest({', '.join(FEATURE_NAMES)}) > -9"

CTES["applicants"] = f"""
SELECT case_id, {', '.join(f'CASE WHEN {f} IN (-9, -8, -7) THEN NULL ELSE {f} END AS {f}' for f in FEATURE_NAMES)},
  CAST({TARGET} = 'Bad' AS INTEGER) AS {TARGET},
  {', '.join(f'CAST({f} = {c} AS INTEGER) AS {indicator_name(f, c)}' for f, c in INDICATORS)}
FROM kept_applicants
"""

CTES["predictions"] = " UNION ALL ".join(
    f"""SELECT case_id, {TARGET} AS true_label, '{m}' AS system,
    floor(60 * ({uniform("'7'", 'case_id', f"'{m}'")} / 4294967296.0::DOUBLE) + 40 * {TARGET}) / 100.0::DOUBLE AS score,
    CAST(floor(60 * ({uniform("'7'", 'case_id', f"'{m}'")} / 4294967296.0::DOUBLE) + 40 * {TARGET}) / 100.0::DOUBLE >= 0.5 AS INTEGER) AS pred FROM applicants"""
    for m in MODELS
)

CTES["systems"] = """
SELECT pipeline AS system, case_id, vote AS label, prob_bad AS score FROM cases
UNION ALL SELECT system, case_id, CASE pred WHEN 1 THEN 'Bad' ELSE 'Good' END, score FROM predictions
"""

CTES["truth"] = "SELECT case_id, min(true_label) AS true_label FROM cases GROUP BY case_id"

CTES["aligned"] = f"""
SELECT case_id, max(t) AS "true", {', '.join(f"max(label) FILTER (WHERE system = '{s}') AS {s}" for s in SYSTEMS)}
FROM (SELECT system, case_id, label, NULL AS t FROM systems
  UNION ALL SELECT NULL, case_id, NULL, CASE true_label WHEN 1 THEN 'Bad' ELSE 'Good' END FROM truth) GROUP BY case_id
"""

CTES["common"] = f"""SELECT * FROM aligned WHERE "true" IS NOT NULL AND {' AND '.join(f'{s} IS NOT NULL' for s in SYSTEMS)}"""


def _right(s: str) -> str:
    return f'({s} = "true")'


CTES["pairs"] = " UNION ALL ".join(
    f"""SELECT '{a} vs {b}' AS comparison, {i} AS place, count(*) FILTER (WHERE NOT {_right(a)} AND NOT {_right(b)}) AS n00,
    count(*) FILTER (WHERE NOT {_right(a)} AND {_right(b)}) AS n01, count(*) FILTER (WHERE {_right(a)} AND NOT {_right(b)}) AS n10,
    count(*) FILTER (WHERE {_right(a)} AND {_right(b)}) AS n11 FROM common"""
    for i, (a, b) in enumerate(PAIRS)
)

# The exact tail from factorials; erfc from a series of positive terms.
CTES["tests"] = """
SELECT *, CASE
    WHEN n_discordant < 25 THEN least(1.0, 2 * list_sum([factorial(n_discordant::INTEGER)::DOUBLE / (factorial(i::INTEGER)::DOUBLE * factorial((n_discordant - i)::INTEGER)::DOUBLE)
      FOR i IN range(0, least(n01, n10) + 1)]) / pow(2.0, n_discordant))
    WHEN statistic = 0 THEN 1.0
    ELSE greatest(0.0, 1 - list_sum([exp((2 * n + 1) * ln(sqrt(statistic / 2)) - lgamma(n + 1.5) - statistic / 2) FOR n IN range(0, 400)]))
  END AS p_value
FROM (SELECT *, CASE WHEN n_discordant < 25 THEN least(n01, n10)::DOUBLE ELSE pow(abs(n01 - n10) - 1, 2) / n_discordant END AS statistic,
  CASE WHEN n_discordant < 25 THEN 'exact_binomial' ELSE 'chi2_continuity_corrected' END AS test_type
  FROM (SELECT *, n01 + n10 AS n_discordant FROM pairs))
"""

CTES["compared"] = """
SELECT case_id, o.vote AS original_label, o.mean_confidence AS original_confidence, v.vote AS variant_label, v.mean_confidence AS variant_confidence,
  o.vote <> v.vote AS flipped, v.mean_confidence - o.mean_confidence AS confidence_delta
FROM (SELECT * FROM cases WHERE pipeline = 'structured' AND vote IS NOT NULL) o
JOIN (SELECT * FROM cases WHERE pipeline = 'stock' AND vote IS NOT NULL) v USING (case_id)
"""

CTES["scored_applicants"] = f"""
SELECT *, floor(60 * ({uniform("'7'", 'case_id', "'boosted'")} / 4294967296.0::DOUBLE) + 40 * {TARGET}) / 100.0::DOUBLE AS score FROM applicants
"""


def _line(wording: str, feature: str, value: str) -> str:
    label, unit = FEATURES[feature]
    shown = wording.replace("{l}", label).replace("{L}", label[0].upper() + label[1:]).replace("{u}", f" {unit}" if unit else "")
    before, _, after = shown.replace("{p}", "{v}").partition("{v}")
    return f"{q(before)} || {value} || {q(after)}"


def _wordings(wordings: list[str], choice: str | None, feature: str, value: str) -> str:
    if choice is None:
        return "(" + _line(wordings[0], feature, value) + ")"
    return "(CASE " + " ".join(f"WHEN {choice} % {len(wordings)} = {i} THEN {_line(w, feature, value)}" for i, w in enumerate(wordings)) + " END)"


def sentence(feature: str, choice: str | None = None) -> str:
    cases = []
    for f, code in INDICATORS:
        if f == feature:
            cases.append(f"WHEN {indicator_name(f, code)} = 1 THEN {_wordings(SENTINEL_WORDINGS, choice, feature, q(SENTINEL_PHRASES[SPECIAL_CODES[code]]))}")
    cases.append(f"WHEN {feature} IS NULL THEN {q(NO_DATA.format(l=FEATURES[feature][0]))}")
    if feature in STATUS_CODES:
        for code, phrase in STATUS_CODES[feature].items():
            cases.append(f"WHEN {feature} = {code} THEN {_wordings(STATUS_WORDINGS, choice, feature, q(phrase))}")
        other = _line(UNMAPPED_STATUS if choice is None else UNMAPPED_STATUS_REWORDED, feature, f"CAST(CAST({feature} AS BIGINT) AS VARCHAR)")
    elif FEATURES[feature][1] == "%":
        other = _wordings(PERCENT_WORDINGS, choice, feature, f"printf('%.1f', {feature})")
    else:
        plain = f"CASE WHEN {feature} = floor({feature}) THEN CAST(CAST({feature} AS BIGINT) AS VARCHAR) ELSE CAST({feature} AS VARCHAR) END"
        other = _wordings(GENERAL_WORDINGS, choice, feature, f"({plain})")
    return f"(CASE {' '.join(cases)} ELSE {other} END)"


CTES["profiles"] = "SELECT case_id, " + " || ' ' || ".join(sentence(f) for f in PROFILE_ORDER) + " AS profile_text FROM applicants"

_CITED = "(CASE {at} " + " ".join(f"WHEN {i} THEN {q(label)}" for i, (label, _) in enumerate(FEATURES.values())) + " END)"

CTES["order_texts"] = f"""
SELECT o_orderkey AS k, o_custkey AS applicant_id, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS true_label,
  CASE WHEN o_orderstatus = 'F' THEN 'Bad' ELSE 'Good' END AS label, CAST(50 + o_orderkey % 50 AS VARCHAR) AS conf,
  CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS amount, CAST(month(o_orderdate) AS VARCHAR) AS month, CAST(day(o_orderdate) AS VARCHAR) AS day,
  {_CITED.format(at=f'(o_orderkey % {len(FEATURES)})')} AS cited, {_CITED.format(at=f'((o_orderkey * 7 + 3) % {len(FEATURES)})')} AS also
FROM orders
"""

CTES["bodies"] = """
SELECT *, '{"label": ' || CASE k % 16 WHEN 3 THEN '"maybe"' WHEN 9 THEN '"  ' || lower(label) || ' "' ELSE '"' || label || '"' END || ', '
  || CASE WHEN k % 16 = 13 THEN '' WHEN k % 5 = 0 THEN '"key_factors": [], '
     ELSE '"key_factors": ["The applicant''s ' || cited || ' is ' || amount || '", "' || also || '", "seen in month ' || month || '"], ' END
  || '"confidence": ' || CASE k % 16 WHEN 4 THEN '140' WHEN 5 THEN '"' || conf || '"' WHEN 12 THEN 'null' WHEN 15 THEN 'true' ELSE conf END
  || CASE k % 16 WHEN 8 THEN '' WHEN 14 THEN ', "explanation": ["a list"]'
     ELSE ', "explanation": "Value ' || amount || ' on day ' || day || ' of month ' || month || ' within 24 months.'
       || CASE k % 16 WHEN 6 THEN ' Also 987654.3 and 1,200 were seen.'
          WHEN 7 THEN CASE label WHEN 'Good' THEN ' This is high risk.' ELSE ' Payment is reliable.' END
          WHEN 10 THEN ' Stated with ' || conf || ' percent, 60+ days in 24.'
          WHEN 11 THEN ' Range ' || day || '-' || month || '.' ELSE '' END || '"' END
  || ', "uncertainty_reason": "none"}' AS body
FROM order_texts
"""

CTES["responses"] = r"""
SELECT k AS case_id, applicant_id, true_label, k % 3 = 0 AS old_parse_success, CAST(amount AS DOUBLE) AS amount, CAST(month AS DOUBLE) AS month, CAST(day AS DOUBLE) AS day,
  CASE k % 16 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN substr(body, 1, 30) WHEN 2 THEN '[' || body || ']' ELSE body END AS raw,
  CASE k % 8 WHEN 0 THEN '**Classification:** **' || label || '**' || chr(10) || '**Confidence:** ' || conf || '%' || chr(10) || '**Explanation:** Value ' || amount
    WHEN 1 THEN 'classification: ' || lower(label) || chr(10) || 'confidence: 140' || chr(10) || 'explanation: none'
    WHEN 2 THEN 'Classification: unsure Classification: ' || label || chr(10) || 'Confidence: ' || conf || chr(10) || 'Explanation: two words'
    WHEN 3 THEN 'Classification: ' || label || chr(10) || 'Confidence: high' || chr(10) || 'Explanation: two words'
    WHEN 4 THEN 'Classification: ' || label || chr(10) || 'Confidence: ' || conf || chr(10) || 'Explanation:   '
    WHEN 5 THEN label || ', surely.'
    ELSE 'Classification: ' || label || chr(10) || 'Confidence: ' || conf || '.5' || chr(10) || 'Explanation: first line' || chr(10) || 'value ' || amount END AS free
FROM bodies
"""

CTES["documents_"] = r"""
SELECT *, CASE WHEN json_valid(clean) THEN CASE WHEN json_type(clean::JSON) = 'OBJECT' THEN clean::JSON END END AS doc
FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(raw, chr(10) || ' '), '^```(json)?\s*', ''), '\s*```$', ''), chr(10) || ' ') AS clean FROM responses)
"""

CTES["fields"] = """
SELECT *, CASE WHEN json_type(doc, '$.label') = 'VARCHAR' THEN
      CASE lower(trim(json_extract_string(doc, '$.label'))) WHEN 'good' THEN 'Good' WHEN 'bad' THEN 'Bad' END END AS label,
  CASE WHEN json_type(doc, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(doc, '$.confidence') AS DOUBLE)
    WHEN json_extract_string(doc, '$.confidence') = 'true' AND json_type(doc, '$.confidence') = 'BOOLEAN' THEN 1.0::DOUBLE END AS stated,
  CASE WHEN json_type(doc, '$.key_factors') = 'ARRAY' THEN CAST(json_extract(doc, '$.key_factors') AS VARCHAR[]) END AS factors,
  coalesce(json_type(doc, '$.explanation'), 'NULL') IN ('NULL', 'VARCHAR') AS usable,
  CASE WHEN json_type(doc, '$.explanation') = 'VARCHAR' THEN json_extract_string(doc, '$.explanation') END AS explanation,
  json_extract_string(doc, '$.uncertainty_reason') AS uncertainty_reason
FROM documents_
"""


def _loose(vocabulary: list[float]) -> str:
    allowed = f"list_concat([{', '.join(f'{v!r}::DOUBLE' for v in vocabulary)}], [amount, month, day])"
    return f"""CASE WHEN doc IS NOT NULL AND usable THEN
    [n FOR n IN [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(concat_ws(' ', array_to_string(factors, ' '), coalesce(explanation, '')), {q(NUMBER_PATTERN)})]
     IF (stated IS NULL OR n <> stated) AND NOT list_contains({allowed}, round_even(n, 1)) AND NOT list_contains({allowed}, round_even(n, 0))] END"""


def _contra(label: str) -> str:
    return " OR ".join(f"contains(lower(coalesce(explanation, '')), {q(term)})" for term in CONTRADICTIONS[label])


def _checked(vocabulary: list[float]) -> str:
    return f"""
SELECT *, coalesce(doc IS NOT NULL AND usable AND label IS NOT NULL AND confidence IS NOT NULL AND explanation IS NOT NULL
    AND coalesce(explanation_grounded, true) AND coalesce(no_contradiction, true), false) AS parse_success
FROM (SELECT *, doc IS NOT NULL AS is_valid_json, label IS NOT NULL AS label_valid, confidence IS NOT NULL AS confidence_valid, len(loose) = 0 AS explanation_grounded,
    CASE label WHEN 'Good' THEN NOT ({_contra('Good')}) WHEN 'Bad' THEN NOT ({_contra('Bad')}) END AS no_contradiction
  FROM (SELECT *, CASE WHEN stated BETWEEN 0 AND 100 THEN stated END AS confidence, {_loose(vocabulary)} AS loose FROM fields))
"""


CTES["parsed"] = _checked(vocabulary_numbers())
CTES["parsed_before"] = _checked(vocabulary_numbers(with_status_labels=False))

_LABELS = ", ".join(f"{{'size': {len(label)}, 'place': -{i}, 'name': '{name}', 'label': {q(label.lower())}}}" for i, (name, (label, _)) in enumerate(FEATURES.items()))
_FEATURE_OF = f"list_sort([l FOR l IN [{_LABELS}] IF contains(lower(f), l.label)])[-1].name"

CTES["mapped"] = f"""
SELECT *, list_sort(list_distinct([m FOR m IN found IF m IS NOT NULL])) AS cited_features, len(found) AS n_factors,
  len([m FOR m IN found IF m IS NULL]) AS n_unmapped
FROM (SELECT *, [{_FEATURE_OF} FOR f IN coalesce(factors, [])] AS found FROM parsed WHERE parse_success)
"""

CTES["means"] = f"SELECT {', '.join(f'round(avg({f}), 6) AS m_{f}' for f in FEATURE_NAMES)} FROM applicants"


def _weight(method: str, model: str, f: str) -> str:
    return f"coalesce({coefficient(method, model, f)!r}::DOUBLE * (a.{f} - m_{f}), 0)"


CTES["tops"] = " UNION ALL ".join(
    f"""SELECT case_id, '{method}' AS method, '{model}' AS model, [s.f FOR s IN list_sort([{', '.join(
        f"{{'w': -abs(round({_weight(method, model, f)}, 6)), 'f': '{f}'}}" for f in FEATURE_NAMES)}])[1:5]] AS top FROM applicants a, means"""
    for method in METHODS
    for model in MODELS
)

CTES["tops_wide"] = f"""
SELECT case_id AS applicant_id, {', '.join(f"first(top) FILTER (WHERE method = '{me}' AND model = '{mo}') AS top_{me}_{mo}" for me, mo in CONDITIONS)} FROM tops GROUP BY case_id
"""

CTES["precisions"] = f"""
SELECT m.case_id AS response_id, coalesce(m.label, '') = CASE m.true_label WHEN 1 THEN 'Bad' ELSE 'Good' END AS correct,
  {', '.join(f"CASE WHEN top_{me}_{mo} IS NOT NULL THEN len(list_intersect(cited_features, top_{me}_{mo})) / nullif(len(cited_features), 0) END AS precision_{me}_{mo}" for me, mo in CONDITIONS)}
FROM mapped m LEFT JOIN tops_wide USING (applicant_id)
"""

CTES["shuffled"] = f"""
SELECT case_id, {TARGET}, row_number() OVER (PARTITION BY {TARGET} ORDER BY md5(concat_ws('|', '42', case_id))) AS rank,
  count(*) OVER (PARTITION BY {TARGET}) AS size, count(*) OVER () AS total FROM applicants
"""

# Shares of the classes: whole parts first, then one more by largest remainder.
CTES["test_sizes"] = f"""
SELECT {TARGET}, size, total, n_test, floor(n_test * size / total) + CAST(row_number() OVER (ORDER BY n_test * size / total - floor(n_test * size / total) DESC, {TARGET})
  <= n_test - sum(floor(n_test * size / total)) OVER () AS INTEGER) AS test
FROM (SELECT DISTINCT {TARGET}, size, total, ceil(total * 0.15::DOUBLE) AS n_test FROM shuffled)
"""

CTES["val_sizes"] = f"""
SELECT {TARGET}, test, floor(n_val * rest / total_rest) + CAST(row_number() OVER (ORDER BY n_val * rest / total_rest - floor(n_val * rest / total_rest) DESC, {TARGET})
  <= n_val - sum(floor(n_val * rest / total_rest)) OVER () AS INTEGER) AS val
FROM (SELECT {TARGET}, test, size - test AS rest, total - n_test AS total_rest, ceil((total - n_test) * (0.15::DOUBLE / (1 - 0.15::DOUBLE))) AS n_val FROM test_sizes)
"""

CTES["split"] = f"""
SELECT case_id, {TARGET}, CASE WHEN rank <= test THEN 'test' WHEN rank <= test + val THEN 'val' ELSE 'train' END AS split
FROM shuffled JOIN val_sizes USING ({TARGET})
"""

CTES["perturbed"] = "SELECT case_id, " + ", ".join(
    "CASE WHEN {f} IS NOT NULL THEN round_even({bound}, 1) END AS {f}".format(
        f=f,
        bound=("greatest(0.0::DOUBLE, least(100.0::DOUBLE, {v}))" if f != "ExternalRiskEstimate" else "greatest(0.0::DOUBLE, {v})").format(
            v=f"({f} + (({uniform(q('42'), 'case_id', q(f))} / 4294967296.0::DOUBLE) * {2.0 * m!r}::DOUBLE - {float(m)!r}::DOUBLE))"
        ),
    )
    for f, m in PERTURBATIONS.items()
) + " FROM applicants"

CTES["sampled"] = "SELECT * FROM applicants ORDER BY md5(concat_ws('|', '42', case_id)) LIMIT 100"

CTES["flagged_users"] = """
SELECT u.case_id, coalesce(n.never, false) AS always_fails FROM (SELECT DISTINCT user_id AS case_id FROM events) u
LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE parse_success) = 0 AS never FROM runs GROUP BY case_id) n USING (case_id)
"""

CTES["grid_point"] = """
SELECT 'logistic_regression' AS family, '{"C": ' || c || '}' AS params FROM (VALUES ('0.01'), ('0.1'), ('1'), ('10'), ('100')) v(c)
UNION ALL SELECT 'random_forest', '{"trees": ' || t || ', "depth": ' || d || ', "leaf": ' || l || '}'
  FROM (VALUES (100), (300)) v(t), (VALUES (30), (10), (20)) w(d), (VALUES (1), (5)) x(l)
UNION ALL SELECT 'boosted_trees', '{"trees": ' || t || ', "depth": ' || d || ', "rate": ' || r || '}'
  FROM (VALUES (100), (300)) v(t), (VALUES (3), (5), (7)) w(d), (VALUES ('0.01'), ('0.1')) x(r)
"""

CTES["rule_mix"] = """
SELECT case_id, s, CASE WHEN s & 1 > 0 THEN ExternalRiskEstimate ELSE ba END AS a, CASE WHEN s & 2 > 0 THEN NumTotalTrades ELSE bb END AS b,
  CASE WHEN s & 4 > 0 THEN PercentTradesNeverDelq ELSE bc END AS c
FROM applicants, (SELECT range AS s FROM range(8)), (VALUES (60.0, 12.0, 80.0), (85.0, 5.0, 50.0)) v(ba, bb, bc)
"""

CTES["rule_game"] = """
SELECT case_id, s, avg((
  CASE WHEN a IS NULL OR a <= 66 THEN CASE WHEN b <= 9 THEN 0.9::DOUBLE WHEN a IS NULL OR a <= 55 THEN 0.8 ELSE 0.5 END WHEN c <= 70 THEN 0.4 ELSE 0.1 END
  + CASE WHEN b IS NULL OR b <= 11 THEN 0.3::DOUBLE WHEN a <= 80 THEN 0.6 ELSE 0.2 END) / 2) AS v
FROM rule_mix GROUP BY case_id, s
"""

CTES["spread"] = """
  SELECT feature, round(coefficient * deviation, 4) AS weight FROM (
    SELECT stddev_pop(coalesce(ExternalRiskEstimate, 0)) AS a, stddev_pop(coalesce(NumTotalTrades, 0)) AS b, stddev_pop(coalesce(MSinceOldestTradeOpen, 0)) AS c,
      stddev_pop(coalesce(NetFractionRevolvingBurden, 0)) AS d FROM applicants),
  LATERAL (VALUES ('ExternalRiskEstimate', -0.01::DOUBLE, a), ('NumTotalTrades', 0.02, b), ('MSinceOldestTradeOpen', -0.005, c), ('NetFractionRevolvingBurden', 0.03, d)) v(feature, coefficient, deviation)
"""

NEEDS = {name: [other for other in CTES if other != name and f" {other} " in f" {body} ".replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " ")] for name, body in CTES.items()}


def with_tables(body: str) -> str:
    """The query with the common tables it reads, in order of definition."""
    flat = f" {body} ".replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " ")
    todo, used = [n for n in CTES if f" {n} " in flat], set()
    while todo:
        name = todo.pop()
        if name not in used:
            used.add(name)
            todo += NEEDS[name]
    tables = ", ".join(f"{name} AS ({CTES[name]})" for name in CTES if name in used)
    return f"WITH {tables} {body}" if tables else body


def described(source: str, by: str, value: str, extra: str = "", digits: int = 6) -> str:
    v = f"CAST({value} AS DOUBLE)"
    quantiles = ", ".join(f"round(quantile_cont({v}, {p}), {digits}) AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    return f"""SELECT {by}, count({value}) AS count, round(avg({v}), {digits}) AS mean, round(stddev_samp({v}), {digits}) AS std, round(min({v}), {digits}) AS min,
    {quantiles}, round(max({v}), {digits}) AS max{extra} FROM {source} GROUP BY 1"""


SQL: dict[str, str] = {}

SQL["majority_vote_accuracy"] = """SELECT pipeline, count(*) AS n_cases, round(avg(CAST(vote = true_name AS INTEGER)), 6) AS accuracy
FROM cases WHERE vote IS NOT NULL GROUP BY pipeline"""

SQL["confusion_cube"] = """SELECT pipeline, coalesce(true_name, 'All') AS "true", coalesce(vote, 'All') AS predicted, count(*) AS n_cases
FROM cases WHERE vote IS NOT NULL GROUP BY GROUPING SETS ((pipeline, true_name, vote), (pipeline, true_name), (pipeline, vote), (pipeline))"""

SQL["case_consistency"] = "SELECT pipeline, case_id, n_runs, n_parsed, vote, true_name, never_parsed, round(consistency, 6) AS consistency FROM cases"

SQL["low_consistency_split"] = """SELECT pipeline, count(*) FILTER (WHERE consistency < 0.6) AS n_low, count(*) FILTER (WHERE never_parsed) AS n_never_parsed,
count(*) FILTER (WHERE consistency < 0.6) - count(*) FILTER (WHERE never_parsed) AS n_split FROM cases GROUP BY pipeline"""

SQL["consistency_describe"] = described("cases", "pipeline", "consistency")

SQL["run_completeness"] = """SELECT pipeline, n_seen_cases, n_records, n_repeats, n_planned_cases, n_planned_cases * n_repeats AS n_expected,
  n_seen_cases >= n_planned_cases AND n_records >= n_planned_cases * n_repeats AS complete
FROM (SELECT pipeline, CAST(sum(k) AS BIGINT) AS n_seen_cases, CAST(sum(k * n_runs) AS BIGINT) AS n_records, first(n_runs ORDER BY k DESC, n_runs) AS n_repeats,
  (SELECT count(DISTINCT user_id) FROM events) AS n_planned_cases
  FROM (SELECT pipeline, n_runs, count(*) AS k FROM (SELECT pipeline, case_id, count(*) AS n_runs FROM interrupted GROUP BY ALL) GROUP BY ALL) GROUP BY pipeline)"""

SQL["run_progress"] = """SELECT pipeline, count(*) AS n_planned, count(r.case_id) AS n_done, count(*) - count(r.case_id) AS n_open
FROM runs LEFT JOIN interrupted r USING (pipeline, case_id, seed) GROUP BY pipeline"""

SQL["resume_plan"] = "SELECT pipeline, case_id, seed FROM runs ANTI JOIN interrupted USING (pipeline, case_id, seed)"

SQL["confidence_describe"] = described("(SELECT * FROM runs WHERE parse_success)", "pipeline", "confidence", ", coalesce(stddev_samp(confidence) < 5, false) AS low_spread")

SQL["label_distribution"] = """SELECT pipeline, label, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (PARTITION BY pipeline), 6) AS share
FROM runs WHERE parse_success GROUP BY pipeline, label"""

SQL["true_label_distribution"] = """SELECT pipeline, CASE true_label WHEN 1 THEN 'Bad' ELSE 'Good' END AS true_name, count(*) AS n_rows,
round(count(*) / sum(count(*)) OVER (PARTITION BY pipeline), 6) AS share FROM runs GROUP BY pipeline, true_label"""

SQL["parse_rates"] = """SELECT pipeline, count(*) AS n_records, count(*) FILTER (WHERE parse_success) AS n_parse_success,
round(avg(CAST(parse_success AS INTEGER)), 6) AS rate_parse_success FROM runs GROUP BY pipeline"""

SQL["prob_bad_per_case"] = """SELECT pipeline, case_id, true_label, round(mean_confidence, 6) AS mean_confidence, round(prob_bad, 6) AS prob_bad
FROM cases WHERE n_parsed > 0"""

SQL["run_timing"] = """SELECT pipeline, round(mean, 6) AS mean_seconds, n_planned, round(mean * n_planned / 3600.0, 6) AS projected_hours FROM (
  SELECT pipeline, avg(elapsed_seconds) FILTER (WHERE (case_id + seed) % 7 <> 0) AS mean, count(*) AS n_planned FROM runs GROUP BY pipeline)"""

SQL["false_negative_examples"] = """SELECT pipeline, case_id, raw_response FROM runs SEMI JOIN (
  SELECT pipeline, case_id FROM cases WHERE true_name = 'Bad' AND vote = 'Good' QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY case_id) <= 3) x
USING (pipeline, case_id) WHERE seed = 0"""

SQL["votes_without_label"] = """SELECT pipeline, case_id, count(*) FILTER (WHERE parse_success) AS n_parsed, count(*) FILTER (WHERE parse_success AND shown IS NULL) AS n_unlabelled,
  count(*) FILTER (WHERE parse_success AND shown = 'Good') AS n_good, count(*) FILTER (WHERE parse_success AND shown = 'Bad') AS n_bad,
  CASE WHEN n_good + n_bad = 0 THEN NULL WHEN n_bad > n_good OR (n_bad = n_good AND min(seed) FILTER (WHERE parse_success AND shown = 'Bad')
    < min(seed) FILTER (WHERE parse_success AND shown = 'Good')) THEN 'Bad' ELSE 'Good' END AS vote
FROM (SELECT *, CASE WHEN case_id % 4 <> 0 AND seed % 3 <> 0 THEN label END AS shown FROM runs) GROUP BY pipeline, case_id"""

SQL["uniform_answers"] = """SELECT pipeline, n_low = 0 AND low_spread AS uniform_answers
FROM (SELECT pipeline, count(*) FILTER (WHERE consistency < 0.6) AS n_low FROM cases GROUP BY pipeline)
JOIN (SELECT pipeline, coalesce(stddev_samp(confidence) < 5, false) AS low_spread FROM runs WHERE parse_success GROUP BY pipeline) USING (pipeline)"""

SQL["always_failing_cases"] = """SELECT count(*) FILTER (WHERE never) AS n_failing, count(*) AS n_cases
FROM (SELECT case_id, count(*) FILTER (WHERE parse_success) = 0 AS never FROM runs GROUP BY case_id)"""

SQL["aligned_cases"] = "SELECT count(*) AS n_cases, (SELECT count(*) FROM common) AS n_common, count(*) - (SELECT count(*) FROM common) AS n_dropped FROM aligned"

SQL["system_accuracy"] = " UNION ALL ".join(
    f"SELECT '{s}' AS system, count(*) AS n_cases, round(avg(CAST({_right(s)} AS INTEGER)), 6) AS accuracy FROM common" for s in SYSTEMS
)

SQL["paired_counts"] = "SELECT comparison, n00, n01, n10, n11 FROM pairs"

SQL["mcnemar_statistic"] = "SELECT comparison, n_discordant, test_type, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM tests"

SQL["holm_adjust"] = f"""SELECT family, comparison, round(p_value, 6) AS p_value, CASE WHEN family = 'primary' THEN round(least(1.0, step), 6) END AS p_value_holm,
  CASE WHEN family = 'primary' THEN least(1.0, step) <= 0.05 END AS significant
FROM (SELECT *, max((m - rn + 1) * p_value) OVER (PARTITION BY family ORDER BY rn) AS step
  FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, comparison) AS rn, count(*) OVER (PARTITION BY family) AS m
    FROM (SELECT *, CASE WHEN place < {len(PRIMARY_PAIRS)} THEN 'primary' ELSE 'secondary' END AS family FROM tests)))"""


def _bins(source: str, op: str) -> str:
    steps = " + ".join(f"CAST(score {op} {k * 0.1!r}::DOUBLE AS INTEGER)" for k in range(1, 10))
    return f"SELECT system, {steps} AS bin, count(*) AS n, avg(true_label) AS y, avg(score) AS p, sum(pow(score - true_label, 2)) AS sq FROM {source} GROUP BY ALL"


def _calibration(source: str) -> str:
    return f"""SELECT system, CAST(sum(n) AS BIGINT) AS n_cases, round(sum(sq) / sum(n), 6) AS brier_score, round(sum(n * abs(y - p)) / sum(n), 6) AS ece
FROM ({_bins(source, '>=')}) GROUP BY system"""


SQL["system_calibration"] = _calibration("(SELECT s.system, s.score, t.true_label FROM systems s JOIN truth t USING (case_id) WHERE s.score IS NOT NULL)")
SQL["brier_ece"] = _calibration("predictions")
SQL["calibration_curve"] = f"""SELECT system, bin, n AS n_cases, round(y, 6) AS prob_true, round(p, 6) AS prob_pred FROM ({_bins('predictions', '>')})"""

SQL["robustness_flips"] = """SELECT count(*) AS n_cases, count(*) FILTER (WHERE flipped) AS n_flipped, round(avg(CAST(flipped AS INTEGER)), 6) AS flip_rate,
round(avg(abs(confidence_delta)), 6) AS mean_abs_delta, round(max(abs(confidence_delta)), 6) AS max_abs_delta FROM compared"""

SQL["flip_directions"] = "SELECT original_label || ' -> ' || variant_label AS direction, count(*) AS n_cases FROM compared WHERE flipped GROUP BY 1"

SQL["attempted_without_vote"] = "SELECT case_id FROM cases WHERE pipeline = 'stock' AND vote IS NULL"

SQL["flipped_examples"] = """SELECT case_id, max(raw_response) FILTER (WHERE pipeline = 'structured') AS original_response,
  max(raw_response) FILTER (WHERE pipeline = 'stock') AS variant_response
FROM (SELECT * FROM runs WHERE parse_success QUALIFY row_number() OVER (PARTITION BY pipeline, case_id ORDER BY seed) = 1) r
SEMI JOIN (SELECT case_id FROM compared WHERE flipped ORDER BY case_id LIMIT 3) x USING (case_id) GROUP BY case_id"""

_CONFUSION = """SELECT system, count(*) FILTER (WHERE true_label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE true_label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE true_label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE true_label = 1 AND pred = 1) AS tp FROM predictions GROUP BY system"""
_RATES = """round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""

SQL["binary_metrics"] = f"SELECT system, tn, fp, fn, tp, {_RATES} FROM ({_CONFUSION})"

_RANKED = """SELECT system, pos, neg, sum(neg) OVER (PARTITION BY system ORDER BY score) - neg AS below, sum(pos) OVER (PARTITION BY system ORDER BY score DESC) AS hits,
  sum(pos + neg) OVER (PARTITION BY system ORDER BY score DESC) AS taken, sum(pos) OVER (PARTITION BY system) AS p, sum(neg) OVER (PARTITION BY system) AS n
FROM (SELECT system, score, count(*) FILTER (WHERE true_label = 1) AS pos, count(*) FILTER (WHERE true_label = 0) AS neg FROM predictions GROUP BY ALL)"""

SQL["roc_auc"] = f"""SELECT system, CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg, round(sum(pos * (below + neg / 2)) / (max(p) * max(n)), 6) AS roc_auc
FROM ({_RANKED}) GROUP BY system"""

SQL["average_precision"] = f"SELECT system, round(sum(pos * hits / taken) / max(p), 6) AS average_precision FROM ({_RANKED}) GROUP BY system"

SQL["metrics_summary"] = f"""SELECT system, accuracy, precision, recall, f1, roc_auc, pr_auc FROM (SELECT system, {_RATES} FROM ({_CONFUSION}))
JOIN (SELECT system, round(sum(pos * (below + neg / 2)) / (max(p) * max(n)), 6) AS roc_auc, round(sum(pos * hits / taken) / max(p), 6) AS pr_auc
  FROM ({_RANKED}) GROUP BY system) USING (system)"""

SQL["eval_subset"] = f"""SELECT printf('case_%04d', row_number() OVER (ORDER BY md5(concat_ws('|', '42', case_id)), case_id) - 1) AS case_id, case_id AS original_case_id, {TARGET}, score
FROM (SELECT *, row_number() OVER (PARTITION BY {TARGET} ORDER BY abs(score - 0.5) DESC, case_id) AS a, row_number() OVER (PARTITION BY {TARGET} ORDER BY abs(score - 0.5), case_id) AS b
  FROM scored_applicants ) WHERE a <= 25 OR b <= 25"""

_LABEL = f"CASE {TARGET} WHEN 1 THEN 'Bad' ELSE 'Good' END"
_FACTORS = " || '{sep}' || ".join(sentence(f) for f in CORE_FACTORS)
SQL["worked_examples"] = f"""SELECT example, case_id, profile_text, {_LABEL} AS label,
  CAST(CASE example WHEN 'borderline' THEN round_even(greatest(score, 1 - score) * 100, 0) ELSE 90 END AS BIGINT) AS confidence,
  {_FACTORS.replace('{sep}', '|')} AS key_factors,
  {q(EXPLANATION_OPENING)} || {_FACTORS.replace('{sep}', ' ')} || CASE WHEN PercentTradesNeverDelq >= 99.5 AND (NumTrades90Ever2DerogPubRec > 0
    OR NumTrades60Ever2DerogPubRec > 0) THEN {q(TENSION_NOTE)} ELSE '' END || replace({q(EXPLANATION_CLOSING)}, '{{label}}', {_LABEL}) AS explanation,
  CASE example WHEN 'borderline' THEN {q(MODERATE_UNCERTAINTY)} ELSE {q(LOW_UNCERTAINTY)} END AS uncertainty_reason
FROM ((SELECT 'good' AS example, * FROM scored_applicants WHERE {TARGET} = 0 ORDER BY score, case_id LIMIT 1)
  UNION ALL (SELECT 'bad', * FROM scored_applicants WHERE {TARGET} = 1 ORDER BY score DESC, case_id LIMIT 1)
  UNION ALL (SELECT 'borderline', * FROM scored_applicants ORDER BY abs(score - 0.5), case_id LIMIT 1)) JOIN profiles USING (case_id)"""

SQL["rename_columns"] = f"SELECT case_id, {', '.join(FEATURE_NAMES)}, {TARGET} FROM raw_applicants"
SQL["drop_unusable"] = f"SELECT case_id, ExternalRiskEstimate, {TARGET} FROM kept_applicants"
SQL["sentinel_encode"] = "SELECT * FROM applicants"

SQL["special_code_counts"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {c} AS code, '{m}' AS meaning, count(*) FILTER (WHERE {f} = {c}) AS n_rows FROM raw_applicants"
    for f in FEATURE_NAMES
    for c, m in SPECIAL_CODES.items()
) + ") WHERE n_rows > 0 ORDER BY n_rows DESC, feature, code LIMIT 10"

SQL["target_polarity"] = f"""SELECT round(g, 6) AS mean_good, round(b, 6) AS mean_bad, b > g AS swapped
FROM (SELECT avg(ExternalRiskEstimate) FILTER (WHERE {TARGET} = 'Good') AS g, avg(ExternalRiskEstimate) FILTER (WHERE {TARGET} = 'Bad') AS b
  FROM raw_applicants WHERE ExternalRiskEstimate >= 0)"""

SQL["target_distribution"] = f"SELECT {TARGET}, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM raw_applicants GROUP BY {TARGET}"

_FLAGS = " + ".join(f"CAST({f} = {c} AS INTEGER)" for f in FEATURE_NAMES for c in SPECIAL_CODES)
SQL["sentinel_flags"] = f"SELECT case_id, {_FLAGS} AS n_sentinel_flags FROM kept_applicants"
SQL["fill_missing"] = f"SELECT case_id, {', '.join(f'coalesce({f}, 0) AS {f}' for f in FEATURE_NAMES)} FROM applicants"

SQL["stratified_split"] = f"SELECT case_id, {TARGET}, split FROM split"
SQL["table_metadata"] = f"""
SELECT split, count(*) AS n_rows, count(*) AS n_read, round(avg({TARGET}), 6) AS share_bad, any_value(n) AS n_indicators FROM split,
  (SELECT {' + '.join(f'CAST(count(*) FILTER (WHERE {f} = {c}) > 0 AS INTEGER)' for f in FEATURE_NAMES for c in SPECIAL_CODES)} AS n FROM kept_applicants)
GROUP BY split
"""

# What the search covers: every combination of the settings, on all rows of the train split.
SQL["grid_search_rows"] = "SELECT family, params, 5::BIGINT AS n_folds, n AS n_rows FROM grid_point, (SELECT count(*) AS n FROM split WHERE split = 'train')"

_FAMILIES = "(VALUES ('logistic_regression'), ('random_forest'), ('boosted_trees')) f(system)"
SQL["score_gap"] = f"SELECT system, case_id, 0.0::DOUBLE AS gap FROM applicants, {_FAMILIES}"
SQL["tree_attribution_gap"] = f"SELECT system, case_id, true AS all_features, 0.0::DOUBLE AS gap FROM applicants, {_FAMILIES} WHERE system <> 'logistic_regression'"
SQL["surrogate_residuals"] = f"SELECT system, case_id, 0.0::DOUBLE AS residual, true AS r2_at_most_1 FROM applicants, {_FAMILIES}"

# Shapley values by all eight coalitions of three features, the rest from either background row.
SQL["rule_tree_attribution"] = """
SELECT w.case_id, feature, round(sum((w.v - o.v) / CASE bit_count(o.s) WHEN 1 THEN 6 ELSE 3 END), 6) + 0.0 AS weight
FROM (VALUES ('ExternalRiskEstimate', 1), ('NumTotalTrades', 2), ('PercentTradesNeverDelq', 4)) f(feature, bit)
JOIN rule_game o ON o.s & bit = 0 JOIN rule_game w ON w.case_id = o.case_id AND w.s = o.s | bit GROUP BY w.case_id, feature
"""

SQL["surrogate_of_linear_score"] = "SELECT case_id, feature, weight, 1.0::DOUBLE AS r2 FROM applicants, spread"

SQL["stratified_split_sizes"] = f"SELECT split, {TARGET}, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM split GROUP BY split, {TARGET}"
SQL["stratified_folds"] = f"SELECT case_id, {TARGET}, " + "CASE " + " ".join(f"WHEN rank <= size * {i + 1} // 5 THEN {i}" for i in range(4)) + " ELSE 4 END AS fold FROM shuffled"
SQL["sample_rows"] = f"SELECT case_id, {TARGET} FROM applicants ORDER BY md5(concat_ws('|', '42', case_id)) LIMIT 20"
SQL["background_means"] = f"SELECT {', '.join(f'round(avg({f}), 6) AS {f}' for f in FEATURE_NAMES)} FROM sampled"
SQL["profile_texts"] = "SELECT case_id, profile_text FROM profiles"

SQL["reworded_profile"] = "SELECT case_id, array_to_string([s.t FOR s IN list_sort([" + ", ".join(
    f"{{'at': md5(concat_ws('|', 'reword-order', case_id, '{f}')), 't': {sentence(f, '(' + uniform(q('reword-wording'), 'case_id', q(f)) + ' % 12)')}}}" for f in FEATURE_NAMES
) + "])], ' ') AS profile_text FROM applicants"

SQL["status_coverage"] = "SELECT count(*) AS n_rows, " + ", ".join(
    f"count(*) FILTER (WHERE {f} NOT IN ({', '.join(map(str, codes))})) AS unmapped_{f}" for f, codes in STATUS_CODES.items()
) + " FROM applicants"


def _prompt(template: str) -> str:
    before, after = template.split("{profile_text}")
    return f"{q(before)} || profile_text || {q(after)}"


SQL["prompts"] = f"SELECT case_id, {_prompt(STOCK_USER)} AS stock_prompt, {_prompt(STRUCTURED_USER)} AS structured_prompt FROM profiles"
SQL["perturb_numeric"] = f"SELECT case_id, {', '.join(PERTURBATIONS)} FROM perturbed"
SQL["perturbation_magnitude"] = f"""SELECT a.case_id, round({' + '.join(f'coalesce(abs(p.{f} - a.{f}), 0)' for f in PERTURBATIONS)}, 4) AS total_perturbation_magnitude
FROM applicants a JOIN perturbed p USING (case_id)"""

_MOVED = f"SELECT a.case_id, {' + '.join(f'coalesce(abs(p.{f} - a.{f}), 0)' for f in PERTURBATIONS)} AS moved FROM applicants a JOIN perturbed p USING (case_id)"
SQL["magnitude_by_flip"] = described(f"(SELECT flipped, moved FROM compared LEFT JOIN ({_MOVED}) USING (case_id))", "flipped", "moved", digits=4)

SQL["linear_attribution"] = " UNION ALL ".join(
    f"SELECT case_id, '{f}' AS feature, round({_weight('shap', 'logreg', f)}, 4) AS weight FROM applicants a, means" for f in FEATURE_NAMES
)
SQL["topk_factors"] = "SELECT case_id, array_to_string(top, ',') AS top_features FROM tops WHERE method = 'lime' AND model = 'rf'"
SQL["explainer_overlap"] = """SELECT model, count(*) AS n_cases, round(avg(len(list_intersect(a.top, b.top)) / 5), 6) AS mean_overlap
FROM (SELECT * FROM tops WHERE method = 'shap') a JOIN (SELECT * FROM tops WHERE method = 'lime') b USING (case_id, model) GROUP BY model"""

SQL["stock_parse"] = r"""SELECT case_id, label, confidence, explanation, label IS NOT NULL AND confidence IS NOT NULL AND explanation IS NOT NULL AS parse_success
FROM (SELECT case_id, CASE lower(regexp_extract(free, '(?i)classification:?\**\s*\**\s*(\w+)', 1)) WHEN 'good' THEN 'Good' WHEN 'bad' THEN 'Bad' END AS label,
  CASE WHEN c BETWEEN 0 AND 100 THEN c END AS confidence, nullif(trim(regexp_extract(free, '(?is)explanation:?\**\s*\**\s*(.+)', 1), chr(10) || ' '), '') AS explanation
  FROM (SELECT *, TRY_CAST(nullif(regexp_extract(free, '{confidence}', 1), '') AS DOUBLE) AS c FROM responses ))""".replace("{confidence}", STOCK_CONFIDENCE)

SQL["structured_validate"] = """SELECT case_id, label, confidence, array_to_string(factors, '|') AS key_factors, explanation, uncertainty_reason, is_valid_json, label_valid,
confidence_valid, explanation_grounded, no_contradiction, len(loose) AS n_ungrounded, parse_success FROM parsed"""

SQL["check_breakdown"] = " UNION ALL ".join(
    f"""SELECT 'structured' AS pipeline, '{c}' AS "check", count(*) FILTER (WHERE {c}) AS n_pass, count(*) FILTER (WHERE NOT {c}) AS n_fail,
    count(*) FILTER (WHERE {c} IS NULL) AS n_not_evaluated FROM parsed"""
    for c in ("is_valid_json", "label_valid", "confidence_valid", "explanation_grounded", "no_contradiction")
)

_VERDICTS = """count(*) AS n_records, count(*) FILTER (WHERE old) AS n_old_pass, count(*) FILTER (WHERE now) AS n_new_pass,
  count(*) FILTER (WHERE NOT old AND now) AS newly_passing, count(*) FILTER (WHERE old AND NOT now) AS newly_failing"""
SQL["revalidation_diff"] = f"SELECT {_VERDICTS} FROM (SELECT old_parse_success AS old, parse_success AS now FROM parsed WHERE case_id % 50 <> 49)"
SQL["vocabulary_rule_diff"] = f"""SELECT {_VERDICTS} FROM (SELECT b.parse_success AS old, n.parse_success AS now FROM parsed_before b JOIN parsed n USING (case_id))"""
SQL["missing_cases"] = "SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey % 50 = 49"

_DISTANCES = """SELECT case_id, number, list_min([abs(number - v) FOR v IN [amount, month, day]]) AS distance
FROM (SELECT case_id, amount, month, day, unnest(loose) AS number FROM parsed WHERE NOT explanation_grounded)"""
SQL["ungrounded_distance"] = f"SELECT case_id, number, round(distance, 6) AS distance FROM ({_DISTANCES})"
SQL["ungrounded_distance_describe"] = described(f"(SELECT 'distance' AS measure, * FROM ({_DISTANCES}))", "measure", "distance")
SQL["confidence_by_grounding"] = described("(SELECT * FROM parsed WHERE explanation_grounded IS NOT NULL)", "explanation_grounded", "confidence")
SQL["sentinels_of_failing_cases"] = described(
    f"(SELECT coalesce(u.always_fails, false) AS always_fails, {_FLAGS} AS flags FROM kept_applicants LEFT JOIN flagged_users u USING (case_id))", "always_fails", "flags"
)
SQL["borderline_of_failing_cases"] = described(
    "(SELECT always_fails, abs(score - 0.5) AS d FROM flagged_users LEFT JOIN (SELECT * FROM predictions WHERE system = 'boosted') p USING (case_id))", "always_fails", "d"
)

SQL["factor_mapping"] = """SELECT case_id, array_to_string(cited_features, ',') AS cited_features, CAST(n_factors AS INTEGER) AS n_factors,
CAST(n_unmapped AS INTEGER) AS n_unmapped FROM mapped"""
SQL["unmapped_factors"] = """SELECT CAST(sum(n_unmapped) AS BIGINT) AS n_unmapped, CAST(sum(n_factors) AS BIGINT) AS n_factors,
round(sum(n_unmapped) / greatest(sum(n_factors), 1), 6) AS unmapped_rate, sum(n_unmapped) / greatest(sum(n_factors), 1) > 0.1 AS warning FROM mapped"""

SQL["grounding_precision"] = " UNION ALL ".join(
    f"SELECT '{me}_{mo}' AS reference, round(avg(precision_{me}_{mo}), 6) AS mean_precision, count(precision_{me}_{mo}) AS n_valid FROM precisions" for me, mo in CONDITIONS
)
SQL["precision_by_correctness"] = f"SELECT correct, {', '.join(f'round(avg(precision_{me}_{mo}), 6) AS precision_{me}_{mo}' for me, mo in CONDITIONS)} FROM precisions GROUP BY correct"
SQL["lowest_precision"] = f"""SELECT response_id, round(list_avg([{', '.join(f'precision_{me}_{mo}' for me, mo in CONDITIONS)}]), 6) AS mean_precision, correct
FROM precisions WHERE coalesce({', '.join(f'precision_{me}_{mo}' for me, mo in CONDITIONS)}) IS NOT NULL ORDER BY 2, 1 LIMIT 10"""

# The stand-in generator hashes the prompt, which SQL can do as well.
SQL["batch_generate"] = f"""SELECT 'structured' AS pipeline, case_id, seed, {TARGET} AS true_label, CASE WHEN substr(h, 1, 1) < '8' THEN 'Bad' ELSE 'Good' END AS label,
  CAST(50 + ('0x' || substr(h, 2, 2))::BIGINT % 50 AS DOUBLE) AS confidence, true AS explanation_grounded, true AS parse_success
FROM (SELECT p.case_id, CAST(s.seed AS INTEGER) AS seed, a.{TARGET}, md5({_prompt(STRUCTURED_USER)} || '|' || s.seed) AS h
  FROM profiles p JOIN applicants a USING (case_id), range(2) s(seed)) g
ANTI JOIN (SELECT case_id, seed FROM runs WHERE pipeline = 'structured') d USING (case_id, seed)"""

_OPEN_STOCK = "ANTI JOIN (SELECT case_id, seed FROM runs WHERE pipeline = 'stock') d USING (case_id, seed)"
SQL["stock_generate"] = f"""SELECT 'stock' AS pipeline, case_id, seed, {TARGET} AS true_label, CASE WHEN substr(h, 1, 1) < '8' THEN 'Bad' ELSE 'Good' END AS label,
  CAST(50 + ('0x' || substr(h, 2, 2))::BIGINT % 50 AS DOUBLE) AS confidence, 'seen over 24 months' AS explanation, true AS parse_success
FROM (SELECT p.case_id, CAST(s.seed AS INTEGER) AS seed, a.{TARGET}, md5({_prompt(STOCK_USER)} || '|' || s.seed) AS h
  FROM ({SQL['reworded_profile']}) p JOIN applicants a USING (case_id), range(2) s(seed)) g {_OPEN_STOCK}"""
SQL["custom_parser"] = f"""SELECT 'stock' AS pipeline, case_id, seed, {TARGET} AS true_label, CASE WHEN substr(h, 1, 1) < '8' THEN 'Bad' ELSE 'Good' END AS label,
  2::BIGINT AS n_numbers, true AS parse_success
FROM (SELECT p.case_id, CAST(s.seed AS INTEGER) AS seed, a.{TARGET}, md5({_prompt(STOCK_USER)} || '|' || s.seed) AS h
  FROM profiles p JOIN applicants a USING (case_id), range(2) s(seed)) g {_OPEN_STOCK}"""

SQL["csv_lines"] = """SELECT c_custkey AS custkey, c_name AS name, CASE WHEN NOT cut THEN c_nationkey END AS nation,
  CASE WHEN NOT cut AND c_custkey % 10 <> 3 THEN c_acctbal END AS balance, CASE WHEN NOT cut THEN c_mktsegment END AS segment, cut OR c_custkey % 10 = 3 AS broken
FROM (SELECT *, c_custkey % 10 = 7 AS cut FROM customer)"""
SQL["json_lines"] = """SELECT event_type AS kind, count(*) AS n_lines, count(*) FILTER (WHERE event_id % 9 = 4) AS n_broken, count(*) FILTER (WHERE event_id % 9 <> 4) AS n_read,
  CAST(sum(event_id) FILTER (WHERE event_id % 9 <> 4) AS BIGINT) AS sum_of_keys FROM events GROUP BY event_type"""
SQL["log_batches"] = "SELECT pipeline, case_id, seed, label, confidence, CAST(seed % 3 AS INTEGER) AS batch FROM runs"
SQL["csv_round_trip"] = f"SELECT {TARGET}, count(*) AS n_rows, {', '.join(f'CAST(sum(floor({f})) AS BIGINT) AS {f}' for f in FEATURE_NAMES)} FROM kept_applicants GROUP BY {TARGET}"
SQL["results_document"] = SQL["binary_metrics"]
SQL["top_feature_lines"] = "SELECT method, model, CAST(case_id AS VARCHAR) AS case_id, array_to_string(top, ',') AS top_features FROM tops"

_REPORT = {
    "parse_rates": ("parse_rates", ["pipeline"]),
    "labels": ("label_distribution", ["pipeline", "label"]),
    "true_labels": ("true_label_distribution", ["pipeline", "true_name"]),
    "confidence": ("confidence_describe", ["pipeline"]),
    "consistency": ("consistency_describe", ["pipeline"]),
    "stability": ("low_consistency_split", ["pipeline"]),
    "uniform_answers": ("uniform_answers", ["pipeline"]),
    "confusion": ("confusion_cube", ["pipeline", '"true"', "predicted"]),
    "accuracy": ("majority_vote_accuracy", ["pipeline"]),
}
SQL["run_report"] = " UNION ALL ".join(
    f"""SELECT '{table}' AS "table", concat_ws('|', {', '.join(f"coalesce({k}, 'all')" for k in keys)}) AS item, metric, round(value, 6) AS value FROM (
  UNPIVOT (SELECT {', '.join(keys)}, CAST(COLUMNS(* EXCLUDE ({', '.join(keys)})) AS DOUBLE) FROM ({SQL[query]})) ON COLUMNS(* EXCLUDE ({', '.join(keys)})) INTO NAME metric VALUE value)"""
    for table, (query, keys) in _REPORT.items()
)

ORACLE = {name: with_tables(body) for name, body in SQL.items()}

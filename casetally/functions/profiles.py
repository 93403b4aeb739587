"""Sentences and profile texts of an applicant row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetally.functions.draws import pick_sql
from casetally.functions.numbers import one_decimal_sql, plain_number_sql
from casetally.functions.sqltext import array, name, text
from casetally.schema import (
    EXPLANATION_CLOSING,
    EXPLANATION_OPENING,
    CORE_FACTORS,
    FEATURE_NAMES,
    FEATURES,
    PROFILE_ORDER,
    SENTINEL_PHRASES,
    SPECIAL_CODES,
    STATUS_CODES,
    indicator_name,
)

# Wordings of the standard sentence and its variants.
# {l} label, {L} label with a capital, {v} value, {u} unit with a leading blank, {p} phrase.
GENERAL_WORDINGS = [
    "The applicant's {l} is {v}{u}.",
    "For {l}, the recorded value is {v}{u}.",
    "{L}: {v}{u}.",
    "With respect to {l}, this applicant shows {v}{u}.",
]
PERCENT_WORDINGS = [
    "The applicant's {l} is {v}%.",
    "For {l}, the figure is {v} percent.",
    "{L}: {v}%.",
]
SENTINEL_WORDINGS = [
    "For {l}, {p}.",
    "Regarding {l}, {p}.",
    "{L}: {p}.",
]
STATUS_WORDINGS = [
    "The applicant's {l} is: {p}.",
    "Regarding {l}, the recorded status is: {p}.",
    "{L} status: {p}.",
]
NO_DATA = "For {l}, no data is available for this applicant."
UNMAPPED_STATUS = "The applicant's {l} is coded {v}, which does not match any documented category for this field."
UNMAPPED_STATUS_REWORDED = (
    "The applicant's {l} is coded {v}, which does not match any documented category for this field "
    "(this is unexpected and worth investigating)."
)


def _fill(wording: str, feature: str, value: str | None = None) -> str:
    """A wording with label and unit written in, and the value (SQL) joined at its place."""
    label, unit = FEATURES[feature]
    line = wording.format(l=label, L=label[0].upper() + label[1:], u=f" {unit}" if unit else "", v="\x00", p="\x00")
    head, mark, tail = line.partition("\x00")
    return f"concat({text(head)}, {value}, {text(tail)})" if mark else text(line)


def _choose(wordings: Sequence[str], choice: str | None, feature: str, value: str) -> str:
    """The first wording, or the one numbered by ``choice`` (SQL)."""
    if choice is None:
        return _fill(wordings[0], feature, value)
    cases = " ".join(f"WHEN {i} THEN {_fill(w, feature, value)}" for i, w in enumerate(wordings))
    return f"CASE {choice} % {len(wordings)} {cases} END"


def status_phrase(feature: str, value: str) -> str:
    """Phrase of a status code, NULL where the code is not in the dictionary."""
    entries = ", ".join(f"{code}, {text(phrase)}" for code, phrase in STATUS_CODES[feature].items())
    return f"try_element_at(map({entries}), cast({value} AS int))"


def sentinel_phrase(feature: str, indicators: Sequence[str]) -> str | None:
    """Phrase of the first indicator that fired, or None if the table has no indicator for the feature."""
    phrases = {indicator_name(feature, code): SENTINEL_PHRASES[meaning] for code, meaning in SPECIAL_CODES.items()}
    cases = [f"WHEN {name(i)} = 1 THEN {text(phrases[i])}" for i in indicators if i in phrases]
    return f"CASE {' '.join(cases)} END" if cases else None


def sentence(feature: str, indicators: Sequence[str], choice: str | None = None) -> str:
    """SQL of one sentence about a feature: sentinel, missing, status, percentage or plain value."""
    value = name(feature)
    unit = FEATURES[feature][1]
    if feature in STATUS_CODES:
        fallback = UNMAPPED_STATUS if choice is None else UNMAPPED_STATUS_REWORDED
        known = _choose(STATUS_WORDINGS, choice, feature, status_phrase(feature, value))
        stated = f"coalesce({known}, {_fill(fallback, feature, f'cast(cast({value} AS int) AS string)')})"
    elif unit == "%":
        stated = _choose(PERCENT_WORDINGS, choice, feature, one_decimal_sql(value))
    else:
        stated = _choose(GENERAL_WORDINGS, choice, feature, plain_number_sql(value))
    stated = f"CASE WHEN {value} IS NULL OR isnan({value}) THEN {_fill(NO_DATA, feature)} ELSE {stated} END"
    phrase = sentinel_phrase(feature, indicators)
    return stated if phrase is None else f"coalesce({_choose(SENTINEL_WORDINGS, choice, feature, phrase)}, {stated})"


def profile_text(indicators: Sequence[str]) -> Column:
    """All sentences in section order."""
    return F.expr(f"concat_ws(' ', {', '.join(sentence(f, indicators) for f in PROFILE_ORDER)})")


def reworded_profile_text(indicators: Sequence[str], case_id: str = "case_id", seed: str = "reword") -> Column:
    """The same facts in another order and wording, fixed for each case."""
    key = name(case_id)
    parts = [
        f"named_struct('at', md5(concat_ws('|', '{seed}-order', cast({key} AS string), '{f}')), "
        f"'text', {sentence(f, indicators, pick_sql(12, f'{seed}-wording', key, text(f)))})"
        for f in FEATURE_NAMES
    ]
    return F.expr(f"array_join(transform(array_sort({array(parts)}), p -> p.text), ' ')")


PROFILES = {"standard": lambda indicators, case_id="case_id": profile_text(indicators), "reworded": reworded_profile_text}


def unmapped_status(feature: str) -> Column:
    """Whether a present status code is missing from the dictionary."""
    value = name(feature)
    return F.expr(f"{value} IS NOT NULL AND NOT isnan({value}) AND {status_phrase(feature, value)} IS NULL")


# Texts of a worked example.
TENSION_NOTE = (
    " Note that a high percentage of trades never delinquent does not rule out risk: a trade can be flagged in the "
    "60+/90+-day-delinquent-or-derogatory-public-record count due to an associated public record rather than a late "
    "payment on that specific trade, so these two figures are not contradictory."
)
LOW_UNCERTAINTY = (
    "Low uncertainty: the applicant's indicators are consistently aligned with a single classification with no "
    "significant conflicting or missing signals."
)
MODERATE_UNCERTAINTY = (
    "Moderate uncertainty: the applicant's indicators include a mix of positive and risk-related signals rather than "
    "a uniformly clear pattern, so this assessment is less certain than a case with fully consistent indicators."
)


def ideal_response(indicators: Sequence[str], label: Column, confidence: Column, uncertainty: Column) -> Column:
    """The response a worked example shows for a row."""
    factors = F.expr(array(sentence(f, indicators) for f in CORE_FACTORS))
    late = (F.coalesce("NumTrades90Ever2DerogPubRec", F.lit(0.0)) > 0) | (
        F.coalesce("NumTrades60Ever2DerogPubRec", F.lit(0.0)) > 0
    )
    tension = (F.coalesce("PercentTradesNeverDelq", F.lit(0.0)) >= 99.5) & late
    before, after = EXPLANATION_CLOSING.split("{label}")
    explanation = F.concat(
        F.lit(EXPLANATION_OPENING),
        F.array_join(factors, " "),
        F.when(tension, F.lit(TENSION_NOTE)).otherwise(F.lit("")),
        F.lit(before),
        label,
        F.lit(after),
    )
    return F.struct(
        label.alias("label"),
        confidence.cast("long").alias("confidence"),
        factors.alias("key_factors"),
        explanation.alias("explanation"),
        uncertainty.alias("uncertainty_reason"),
    )

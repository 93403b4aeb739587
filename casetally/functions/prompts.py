"""Prompts of the two response formats.

A system prompt is the same for every row; it is built once on the driver and
passed as a constant. Only the user prompt is a column.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetally.schema import EXAMPLE_LAYOUT, EXAMPLES_HEAD, FEATURES, GLOSSARY_HEAD, GLOSSARY_LINE, GLOSSARY_UNIT, RUBRIC, RUBRIC_HEAD

# Wording of the prompts.
STOCK_SYSTEM = (
    "You are a financial assistant helping to assess credit risk for loan applications. You will be given a summary "
    "of an applicant's credit profile. Based on this information, classify the applicant's credit risk."
)
STOCK_USER = """Here is the applicant's credit profile:

{profile_text}

Based on this information, classify this applicant's credit risk performance as either "Good" or "Bad". Also provide a confidence score from 0 to 100, and a short explanation for your classification.

Respond in exactly this format:
Classification: <Good or Bad>
Confidence: <a number from 0 to 100>
Explanation: <one or two sentences>"""
STRUCTURED_ROLE = (
    "You are a financial assistant helping to assess credit risk for loan applications, following a specific "
    "decision rubric."
)
STRUCTURED_FORMAT = """Respond with ONLY a single JSON object, no other text, in exactly this schema:
{
  "label": "Good" or "Bad",
  "confidence": <number 0-100>,
  "key_factors": [<short phrase>, <short phrase>, ...],
  "explanation": "<1-3 sentences>",
  "uncertainty_reason": "<why you are or are not confident>"
}"""
STRUCTURED_USER = "Now classify this applicant:\n\n{profile_text}"
EXAMPLE_SEPARATOR = "\n\n---\n\n"
# End of the fixed values.


def glossary() -> str:
    lines = [GLOSSARY_HEAD]
    for feature, (label, unit) in FEATURES.items():
        line = GLOSSARY_LINE.format(name=feature, label=label)
        lines.append(line + GLOSSARY_UNIT.format(unit=unit) if unit else line)
    return "\n".join(lines)


def example_block(examples: Sequence[dict]) -> str:
    """Worked examples as text; there are a handful of them."""
    return EXAMPLE_SEPARATOR.join(
        EXAMPLE_LAYOUT.format(profile=e["profile_text"], response=json.dumps(e["ideal_response"], indent=2)) for e in examples
    )


def structured_system(examples: Sequence[dict]) -> str:
    sections = [STRUCTURED_ROLE, glossary(), RUBRIC_HEAD.format(rubric=RUBRIC), STRUCTURED_FORMAT, EXAMPLES_HEAD, example_block(examples)]
    return "\n\n".join(sections)


def _around(template: str, profile: Column) -> Column:
    before, _, after = template.partition("{profile_text}")
    return F.concat(F.lit(before), profile, F.lit(after))


def stock_prompt(profile: Column) -> tuple[str, Column]:
    return STOCK_SYSTEM, _around(STOCK_USER, profile)


def structured_prompt(profile: Column, examples: Sequence[dict] = ()) -> tuple[str, Column]:
    return structured_system(examples), _around(STRUCTURED_USER, profile)


PROMPTS = {"stock": lambda profile, examples=(): stock_prompt(profile), "structured": structured_prompt}

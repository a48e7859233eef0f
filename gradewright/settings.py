"""Grading thresholds.

Every operator takes a ``Thresholds`` and turns its fields into literals, so a
changed threshold changes the plan and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # They decide the published results and must stay as they are.
    # marks
    filled: float = 0.50
    empty: float = 0.40
    dark_level: int = 140
    mark_inset: int = 3
    blank_dark_share: float = 0.01
    # readings
    high_confidence: float = 0.80
    fuzzy_match: float = 0.80
    token_sort: bool = True
    token_calibration: float = 0.90
    token_warn: float = 0.40
    token_bad: float = 0.20
    multiline_trigger: float = 0.85
    # letter vote
    letter_noise_floor: float = 0.05
    letter_vote_floor: float = 0.10
    letter_min_share: float = 0.66
    letter_strong_dissent: float = 0.30
    letter_dissent_cap: float = 0.65
    letter_solo_low: float = 0.60
    line_model_discount: float = 0.85
    # boxes
    expand_px: int = 3
    border_inset_px: int = 4
    number_region_pad: int = 4
    page_width: int = 756
    page_height: int = 1086
    # verdicts
    ai_enabled: bool = True
    grading_model: str = "qwen3:1.7b"
    # requests
    request_ttl_seconds: int = 300


DEFAULTS = Thresholds()

# Phrases that force a manual review when a verdict repeats them.
SAFETY_PHRASES = (
    "ignore previous",
    "ignore the rubric",
    "full marks",
    "give full",
    "override",
    "as requested",
)

# Characters stripped from the right of a line reading.
TRAILING_NOISE = " .,;:!?_-'\"`*"

# Payload fields that hold encoded images.
IMAGE_FIELDS = ("studentNumberImage", "answerImage", "solutionAreaImage")

# Digits the digit readers mix up.
CONFUSABLE_DIGITS = ("4", "6", "7", "9")

# Long question type -> short code.
TYPE_CODES = {
    "multiple_choice": "mc",
    "multi_select": "ms",
    "matching": "match",
    "fill_blanks": "fill",
    "open_ended": "open",
}

# Statuses that put a question on the review list of the store.
REVIEW_STATUSES = ("pending_review", "ai_flagged", "error")

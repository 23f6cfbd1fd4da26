"""Parameters and fixed values of the analyses."""

from __future__ import annotations

import math
from dataclasses import dataclass

TOPICS, CONCEPTS = "topics", "concepts"

#: A label pair counts if independence predicts at least so many common works.
MIN_EXPECTED = 3
#: A bridge needs at least so many common works on either side.
MIN_BRIDGE_OBSERVED = 3
DAMPING, TOLERANCE, MAX_ITERATIONS = 0.85, 1e-10, 100
TITLE_WIDTH = 60
SNIPPET_RADIUS = 60
STRATA = 10
SCORERS = ("lift", "cooccurrence", "preferential_attachment", "common_neighbors", "adamic_adar", "jaccard", "random")
POSITIVES = ("co_tagged", "above_chance")
WORK_URL = "https://openalex.org/"


def valid_min_score(value: str | float) -> float:
    """A finite number from 0 to 1."""
    try:
        x = float(str(value).strip())
    except ValueError:
        raise ValueError(f"{value!r} is not a number") from None
    if not math.isfinite(x) or not 0 <= x <= 1:
        raise ValueError(f"{value!r} is not between 0 and 1")
    return x


def valid_limit(value: str | int) -> int:
    """A whole number from 1 on: 0 would overwrite a corpus with an empty one."""
    text = str(value).strip()
    if not text.isdecimal() or int(text) < 1:
        raise ValueError(f"{value!r} is not a whole number from 1 on")
    return int(text)


@dataclass(frozen=True)
class LabelFilter:
    """Which tags of a work count as its labels. Levels hold for concepts alone."""

    taxonomy: str = TOPICS
    min_level: int = 2
    min_score: float = 0.4

    def __post_init__(self):
        if self.taxonomy not in (TOPICS, CONCEPTS):
            raise ValueError(f"unknown taxonomy {self.taxonomy!r}")
        valid_min_score(self.min_score)

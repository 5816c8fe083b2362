"""Settings of the matchers."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SimilarityConfig:
    """How the two string similarities are computed.

    levenshtein_by: which length divides the edit distance, "shorter" or "longer"; with "shorter", strings of
    which one is at most min_length_ratio of the other are not similar at all. boost_threshold: the
    Jaro similarity over which a common prefix counts.
    """

    levenshtein_by: str = "shorter"
    min_length_ratio: float = 0.5
    boost_threshold: float = 0.7
    prefix_weight: float = 0.1


DEFAULT = SimilarityConfig()
#: A pair is a duplicate over this score.
DUPLICATE_SCORE = 0.85
DEFAULT_COUNTRY = "DE"

"""What the corpus teaches about the rules outweighs what is expected of them."""

import math

from quillon.llm import quality


def kept(patterns: dict[str, int], threshold: float = 0.6) -> set[str]:
    prior, odds = quality.believe(patterns)
    return {p for p in patterns if 1 / (1 + math.exp(-prior - sum(t[v] for t, v in zip(odds, p, strict=True)))) >= threshold}


def test_a_rule_that_speaks_against_many_good_documents_is_overruled():
    assert kept({"gggggggg": 500, "gbgggggg": 400, "bbbbgbbb": 60, "bbgbgbbb": 40}) == {"gggggggg", "gbgggggg"}
    assert kept({"gggggggg": 600, "gbgggggg": 3000, "bbgbgggg": 150, "gbbbgggb": 100, "ggbbgbgb": 100}) == {"gggggggg", "gbgggggg"}


def test_a_table_of_junk_keeps_its_clean_rows():
    assert kept({"gggggggg": 100, "bbbbgbbb": 400, "bbgbgbgb": 500, "gbbbgggb": 200}) == {"gggggggg"}


def test_a_rule_that_is_seldom_wrong_rejects_alone():
    assert kept({"gggggggg": 800, "ggggaggg": 30, "gbgggggb": 38, "gbgggggg": 27}) == {"gggggggg", "ggggaggg"}
    assert quality.believe({}) == (0.0, [{"g": 0.0, "b": 0.0, "a": 0.0}] * len(quality.RULES))

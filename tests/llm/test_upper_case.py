"""The share of capitals of whole texts."""

import pytest

from tilesieve.llm import quality_fm


@pytest.mark.parametrize("text", ["abc" * 3000, "aB" * 4000, "x" * 6000 + "ABC" * 900, "a\u00c9\u0416\u03a9 \U00010400" * 2500, "A", ""])
def test_upper_case_of_whole_texts(text):
    assert quality_fm.upper_case(text, text.encode()) == sum(map(str.isupper, text))
    index, value = quality_fm.features(text)
    assert value[6] == pytest.approx(3 * sum(map(str.isupper, text)) / max(1, len(text)))

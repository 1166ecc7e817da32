"""Edit distances of long texts in a band of the table, and how texts reach Python."""

import random

from pyspark.util import PythonEvalType

from lettermill.functions import similarity
from test_accuracy import brute_distance


def test_a_band_gives_the_distance_or_more_than_its_bound():
    rng = random.Random(5)
    within = 0
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        b = "".join(rng.choice(["", c, c, c, c, "x", c + "a"]) for c in a) or "a"
        most = abs(len(a) - len(b)) + rng.randint(0, 20)
        if (most + len(a) - len(b)) // 2 < len(a):
            distance, found = brute_distance(a, b), similarity._banded_distance(len(a), similarity._places(a), b, most)
            assert found == distance if distance <= most else found > most
            within += distance <= most
    assert within > 1000


def test_bands_are_widened_until_they_hold_the_distance(monkeypatch):
    monkeypatch.setattr(similarity, "BANDED", 64)
    rng = random.Random(6)
    for noise in (0.01, 0.05, 0.2, 0.5, 1.0):
        a = [str(rng.randint(0, 30)) for _ in range(700)]
        b = [w if rng.random() > noise else "x" for w in a if rng.random() > noise / 3]
        assert similarity.edit_distance(a, b or ["y"]) == brute_distance(a, b or ["y"])


def test_texts_reach_python_a_hundred_rows_at_a_time():
    for distance in (similarity._char_distance, similarity._word_distance):
        assert distance.evalType == PythonEvalType.SQL_BATCHED_UDF

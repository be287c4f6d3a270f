"""Distances and alignments against a plain evaluator, and expected values."""

import functools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmere.functions import alignment as A
from glyphmere.functions.tables import Confusables

TABLE = Confusables({ord("0"): "O", ord("1"): "l", ord("I"): "l", ord("m"): "rn", ord("|"): "l", 0x430: "a"})


def plain(a, b):
    @functools.cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j - 1) + (a[i - 1] != b[j - 1]), d(i - 1, j) + 1, d(i, j - 1) + 1)
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


words = st.text(alphabet="ab1lé😀m", max_size=9)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=30))
def test_distances_match_plain_evaluation(pairs):
    a, b = map(list, zip(*pairs))
    want = [plain(x, y) for x, y in pairs]
    assert A.distances(a, b).tolist() == want
    assert A.aligned(a, b, TABLE)[0].tolist() == want


@pytest.mark.parametrize(
    "a, b, dist, count, keys",
    [  # fixed values
        ("paypal", "pаypal", 1, 1, None),
        ("rnicrosoft", "microsoft", 2, 0, 0.0866),
        ("google", "gogle", 1, 0, 0.0),
        ("googel", "google", 1, 0, 0.0),
        ("GOOGLE", "GO0GLE", 1, 1, 0.0969),
        ("kitten", "sitting", 3, 0, 0.4765),
        ("lodash", "1odash", 1, 1, 0.7776),
        ("ca", "abc", 3, 0, 0.2033),
        ("", "abc", 3, 0, 0.0),
        ("1l1", "la1l", 3, 0, 0.0),
    ],
)
def test_expected_values(a, b, dist, count, keys):
    d, c, k = A.aligned([a], [b], TABLE)
    assert (d[0], c[0]) == (dist, count)
    assert np.isnan(k[0]) if keys is None else (a == "1l1" or abs(k[0] - keys) < 1e-4)


def test_alignment_is_not_symmetric():
    assert A.aligned(["1l1", "la1l"], ["la1l", "1l1"], TABLE)[1].tolist() == [0, 1]
    k = A.aligned(["pqp", "qapq"], ["qapq", "pqp"], TABLE)[2]
    assert k[0] == 0.0 and abs(k[1] - 0.4345) < 1e-4
    assert abs(float(A.MAX_KEY_DISTANCE) - 11.543396) < 1e-6

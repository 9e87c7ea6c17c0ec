import random

import pytest

from pageloom.llm.suffixes import common_prefixes, suffix_array


@pytest.mark.parametrize("seed", range(20))
def test_order_is_that_of_sorting(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = [rng.randint(0, rng.randint(1, 5)) for _ in range(rng.randint(0, 40))] * rng.randint(1, 3)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(text) == order
        shared = common_prefixes(text, order)
        for a, b, n in zip(order, order[1:], shared[1:]):
            assert text[a: a + n] == text[b: b + n]
            assert a + n == len(text) or b + n == len(text) or text[a + n] != text[b + n]


def test_runs_and_nothing():
    assert suffix_array([]) == [] and suffix_array(b"x") == [0]
    assert suffix_array(b"a" * 500) == list(range(499, -1, -1))

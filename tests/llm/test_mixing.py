"""Mixes of long documents come closest to their budgets too."""

import itertools
import random

import numpy as np
import pandas as pd

from plumbline.llm import mixing


def test_long_documents_alone_meet_the_budget():
    for lengths, budget in ((np.arange(100_000, 100_010), 500_023), (np.arange(20_000, 20_050), 500_613)):
        counts = np.ones(len(lengths), np.int64)
        taken = mixing.fit(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and (taken * lengths).sum() == budget


def test_a_source_of_few_long_documents_takes_some_again():
    lengths = [70_001, 90_011, 120_007]
    words, budget = sum(lengths), 140_000
    group = pd.DataFrame({"key": "=a", "size": lengths, "n": 1, "budget": budget, "words": words, "whole": 1, "most": 2})
    got = mixing._fit_source(group)
    copies = got["base"] + (got["extra"] > 0)
    sums = [sum(a * b for a, b in zip(c, lengths)) for c in itertools.product(range(3), repeat=3)]
    assert (copies * got["size"]).sum() == max(s for s in sums if s <= words + budget)


def test_sums_beyond_the_program_are_the_best_from_below():
    draw = random.Random(12)
    for _ in range(40):
        lengths = np.array(sorted(draw.sample(range(1, 40), 4)))
        counts = np.array([draw.randint(0, 4) for _ in lengths])
        budget = draw.randint(0, 150)
        taken = mixing.fit(lengths, counts, budget, program=1)
        sums = [sum(a * b for a, b in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])]
        assert (taken >= 0).all() and (taken <= counts).all()
        assert (taken * lengths).sum() == max(s for s in sums if s <= budget)

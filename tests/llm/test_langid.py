"""Interpolated Kneser-Ney by plain dictionaries of whole n-grams."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import langid

ORDER = 4


def reduced(text):
    """Lower-case letters with one blank for anything between."""
    out = []
    for c in text:
        low = c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " "
        if low != " " or not out or out[-1] != " ":
            out.append(low)
    return out


class Plain:
    """One language, as in a textbook."""

    def __init__(self, texts):
        self.counts = {ORDER: Counter()}
        for text in texts:
            padded = ["\0"] * (ORDER - 1) + reduced(text)
            for k in range(ORDER - 1, len(padded)):
                self.counts[ORDER][tuple(padded[k - ORDER + 1: k + 1])] += 1
        for order in range(ORDER - 1, 0, -1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for order, counts in self.counts.items():
            one, two = (sum(n == k for n in counts.values()) for k in (1, 2))
            d = one / (one + 2 * two) if one else 0.5
            self.discount[order] = min(max(d, 0.05), 0.95)
            total, kinds = defaultdict(int), defaultdict(int)
            for g, n in counts.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            self.total[order], self.kinds[order] = total, kinds

    def probability(self, gram):
        order = len(gram)
        if not order or (order == 1 and gram[0] not in self.letters):
            return 2.0**-16  # also a letter that no language has
        below = self.probability(gram[1:])
        total = self.total[order].get(gram[:-1], 0)
        if not total:
            return below
        weight = min(self.discount[order] * self.kinds[order][gram[:-1]] / total, 1.0)
        own = self.counts[order].get(gram, 0)
        return (own - self.discount[order]) / total + weight * below if own else weight * below

    def entropy(self, text):
        padded = ["\0"] * (ORDER - 1) + reduced(text)
        logs = [math.log(max(self.probability(tuple(padded[k - ORDER + 1: k + 1])), 2.0**-40))
                for k in range(ORDER - 1, len(padded))]
        return -sum(logs) / len(logs)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    alphabets = {"aa": "etaoin shrdlu", "bb": "eniriat sélçü", "cc": "日本語中文 漢字仮名"}
    return [(lang, "".join(rng.choice(letters) * rng.choice([1, 1, 2]) for _ in range(rng.randint(5, 200))) + rng.choice(["", "!", " 12 x"]))
            for lang, letters in alphabets.items() for _ in range(40)]


def test_entropies_are_those_of_plain_dictionaries(spark, corpus):
    model = langid.train(spark.createDataFrame(corpus, "lang string, text string"))
    plain = {lang: Plain([t for x, t in corpus if x == lang]) for lang in model.langs}
    Plain.letters = {c for _, t in corpus for c in reduced(t)}
    assert model.langs == ["aa", "bb", "cc"]
    texts = [t for _, t in corpus[::7]] + ["hello unseen zzz", "é", "日本", "Ω new letters", "a"]
    best, lowest, letters, certainty = langid.score_texts(model, texts)
    for k, text in enumerate(texts):
        entropies = [plain[x].entropy(text) for x in model.langs]
        assert abs(min(entropies) - lowest[k]) < 1e-3, text
        if sorted(entropies)[1] - min(entropies) > 1e-3:
            assert best[k] == int(np.argmin(entropies)), text
        assert letters[k] == sum(c != " " for c in reduced(text)) and 0 < certainty[k] <= 1


def test_ties_go_to_the_first_name(spark):
    rows = [(lang, "same text in all of them") for lang in ("zz", "mm", "bb")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    best, _, _, certainty = langid.score_texts(model, ["same text", "other"])
    assert [model.langs[b] for b in best] == ["bb", "bb"] and np.allclose(certainty, 1 / 3)


def test_hashes_with_equal_leading_bits_are_told_apart():
    keys = np.sort(np.array([5 << 44, (5 << 44) + 1, (5 << 44) + 9, 7 << 44, 2**64 - 1], np.uint64))
    model = langid.Model(["x"], keys={1: keys})
    asked = np.array([5 << 44, (5 << 44) + 1, (5 << 44) + 2, (5 << 44) + 9, 6 << 44, 7 << 44, 0, 2**64 - 1, 2**64 - 2], np.uint64)
    at, known = model._find("keys", 1, asked)
    assert known.tolist() == [True, True, False, True, False, True, False, True, False]
    assert keys[at[known]].tolist() == asked[known].tolist()

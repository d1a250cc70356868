import random

import numpy as np
import pytest

import maskwright.llm.near_dedup as near_dedup


def family(members, seed, repeated=0):
    """Independent edits of one text, most of them less alike to it than the threshold; every ninth is edited once more.

    repeated: so many members hold a passage twice.
    """
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, members):
        words = rows[-1][1].split() if i % 9 == 0 else list(base)
        for k in range(1 if i % 9 == 0 else rng.choice([1, 3, 4, 5])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [f"n{i}x{k}"], ["the"]])
        rows.append((i, " ".join(words + words[-12:] if i <= repeated else words)))
    return rows


def classes_by_all_pairs(rows):
    number, bags = {}, []
    for _, text in rows:
        own = text.split()
        grams = [number.setdefault(tuple(own[k : k + 5]), len(number)) for k in range(len(own) - 4)]
        bags.append(np.unique(grams, return_counts=True))
    of = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if of[a] != of[b] and near_dedup.likeness(*bags[a], *bags[b]) >= 0.8:
                low, high = sorted((of[a], of[b]))
                of = [low if c == high else c for c in of]
    return {i: c for (i, _), c in zip(rows, of)}


@pytest.mark.parametrize("members, repeated", [(240, 0), (80, 15)])
def test_families_of_edits_have_the_classes_of_all_pairs(spark, monkeypatch, members, repeated):
    """Pairs that are compared grow with the members of a family, not with their square."""
    asked, compared = [], near_dedup.compared

    def counted(*args):
        out = compared(*args)
        asked.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "compared", counted)
    rows = family(members, 7, repeated)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_all_pairs(rows)
    assert len(set(got.values())) > members / 4
    assert repeated or sum(asked[1:]) < members, asked  # the first are those of the buckets' leaders

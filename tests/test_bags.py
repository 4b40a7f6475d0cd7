"""Balanced bags rank only the rows below a bound of their draws, with the same bags."""

import hashlib

import pytest

from emberlog.operators import sampling as S


def drawn(i, bag):
    return int(hashlib.md5(f"{i}|{bag}|42".encode()).hexdigest()[:13], 16)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, 1 if i % 100 == 0 else 0) for i in range(6000)] + [(9001, None)], "log_id long, label int")


def as_sets(df):
    got = {}
    for r in df.collect():
        got.setdefault((r["bag"], r["label"]), set()).add(r["log_id"])
    return got


def test_bags_are_the_smallest_draws(rows):
    want = {}
    for bag in range(3):
        for label in (0, 1):
            mine = [i for i in range(6000) if (i % 100 == 0) == bool(label)]
            want[bag, label] = set(sorted(mine, key=lambda i: (drawn(i, bag), i))[:60])
    assert as_sets(S.balanced_bags(rows, 3)) == want


def test_few_rows_are_ranked(rows, monkeypatch):
    ranked = []
    rank = S.hash_rank
    monkeypatch.setattr(S, "hash_rank", lambda df, *a, **k: ranked.append(df.count()) or rank(df, *a, **k))
    S.balanced_bags(rows, 3).count()
    assert ranked[0] < 3 * (60 + 60 + 250)


def test_short_bag_ranks_all_rows(rows, monkeypatch):
    whole = as_sets(S.balanced_bags(rows, 2))
    monkeypatch.setattr(S, "BITS", 40)  # a bound that nothing passes
    assert as_sets(S.balanced_bags(rows, 2)) == whole


def test_no_rows(rows):
    assert S.balanced_bags(rows.limit(0)).count() == 0

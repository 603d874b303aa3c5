"""The LSH forest against brute force: components on odd rows and given tables, recall of candidates, dense regions."""

import collections
import random

import numpy as np
import pytest
from test_operators import SCHEMA, components_of, shingles, words_of

from cartograin.llm import lsh_forest, ngram_jaccard_join


def odd_rows():
    rng = random.Random(11)
    base = words_of(rng, 150).split()
    out = [(k, None if k == 3 else "" if k == 4 else " \n" if k == 5 else "one two" if k in (6, 7) else "ONE  two" if k == 8 else "one") for k in range(3, 10)]
    for k in range(10, 60):  # a chain of near copies, links of which are close to the limit
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(50)}"
        out.append((k, " ".join(own)))
    out += [(k, words_of(rng, rng.choice([5, 60, 300]))) for k in range(60, 80)]
    out += [(80, words_of(rng, 9000)), (None, " ".join(base)), (None, None), out[9], (90, out[9][1]), (12, words_of(rng, 30))]
    return [(i, t) for i, t in out if i != 12 or t is not None]


def checked(df, rows, width, num, den):
    want = components_of([r for r in rows if r[0] is not None], width, num, den)
    got = lsh_forest.forest_components(df, width, num, den).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((i, len(shingles(t, width))) for i, t in rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id][1]) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)


@pytest.mark.parametrize("block", [256, 4])
def test_components(spark, small, block, monkeypatch):
    monkeypatch.setattr(ngram_jaccard_join, "BLOCK", block)
    rows = [r for r in odd_rows() if r[0] != 12]
    df = spark.createDataFrame([(i, t, *[None] * 3, *["clash"] * 12) for i, t in rows], SCHEMA.replace("n_chars long", "n_chars long"))
    checked(df, rows, 4, 80, 100)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    checked(docs.select("doc_id", "text"), [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 4, 80, 100)


def test_other_similarities(spark):
    rows = [r for r in odd_rows() if r[0] != 12]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (50, 90):
        checked(df, rows, 2, num, 100)


def test_depth_and_agreement():
    assert lsh_forest.shape(80, 100) == (4, 9) or lsh_forest.shape(80, 100)[0] == 4
    depth, need = lsh_forest.shape(80, 100)
    assert (1 - 0.8**depth) ** lsh_forest.TREES < 1e-6 and 6 <= need <= 10
    assert lsh_forest.shape(50, 100)[0] < depth <= lsh_forest.shape(99, 100)[0]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    one, two = lsh_forest.signatures([np.concatenate([common, a]), np.concatenate([common, b])])
    assert abs((one == two).mean() - 0.8) < 0.12


def test_dense_regions_are_cut_deeper(spark, monkeypatch):
    """With regions of 8 entries at most, near copies and what only shares a part with them are still told apart."""
    monkeypatch.setattr(lsh_forest, "DENSE", 8)
    monkeypatch.setattr(lsh_forest, "GATHER", 16)
    rng = random.Random(4)
    base, rows = words_of(rng, 200).split(), []
    for k in range(120):
        own = list(base)
        if k % 3 == 0:
            own[90:] = words_of(rng, 110).split()  # shares 45 in 100 words, linked with nothing
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = "new"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    checked(df, rows, 4, 80, 100)


@pytest.mark.parametrize("near", [2, 31])
def test_groups_of_a_region(near, monkeypatch):
    """Against all pairs: groups are the components of entries of a key that agree in enough places."""
    monkeypatch.setattr(lsh_forest, "NEAR", near)
    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 6, 400))
    view = rng.integers(0, 3, (400, lsh_forest.VIEW)).astype(np.uint8)
    got = lsh_forest.grouped(key, view, 9)
    root = list(range(400))
    for _ in range(400):
        before = list(root)
        for i in range(400):
            for j in np.flatnonzero((key == key[i]) & ((view == view[i]).sum(axis=1) >= 9)):
                root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert got.tolist() == root


def test_empty(spark):
    assert not lsh_forest.forest_components(spark.createDataFrame([], SCHEMA)).collect()
    only = spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, lsh_forest.forest_components(only).collect()), key=str) == [(1, 0, 1, True), (None, 1, None, True)]

"""Importance resampling against brute force: crc32 in step, gains, scores, the draw and quickselect."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import SCHEMA, words_of

from cartograin.llm import importance_resampling as resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return w, [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB7 é漢,.-"), max_size=300), max_size=5), st.integers(1, 3))
def test_features(texts, longest):
    texts = [*texts, None, "x" * 200 + " y" + "é" * 90]
    got = collections.defaultdict(collections.Counter)
    for first, counts, owner, buckets in resampling.features(pa.array(texts, pa.string()), longest, 1000):
        for o, b in zip(owner, buckets):
            got[first + int(o)][int(b)] += 1
        assert counts.tolist() == [len(runs(t, 1)[0]) for t in texts[first : first + len(counts)]]
    assert [got[k] for k in range(len(texts))] == [collections.Counter(zlib.crc32(x.encode()) % 1000 for x in runs(t, longest)[1]) for t in texts]


def drawn(rows, target, percent, least, longest, buckets):
    s, t = collections.Counter(), collections.Counter()
    for texts, held in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            held.update(zlib.crc32(x.encode()) % buckets for x in runs(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w, found = runs(text, longest)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(w)])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest, percent", [(1, 30), (2, 100), (1, 3)])
def test_against_brute_force(spark, longest, percent):
    rng = random.Random(8)
    rows = [(k, words_of(rng, rng.choice([0, 3, 19, 20, 21, 80]))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "... -"), (None, words_of(rng, 50)), (None, None), (203, words_of(rng, 5000)), rows[5], rows[5], (5, words_of(rng, 40))]
    target = [words_of(rng, 30) + " alpha1" * 20 for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame([(i, t, *[None] * 3, *["clash"] * 12) for i, t in rows], SCHEMA.replace("label string", "score string").replace("h string", "weight string"))
    aims = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(target)], "item_id long, text string, weight string")
    got = resampling.resampled(docs, aims, percent, 20, longest, 500)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert collections.Counter(map(tuple, got.collect())) == drawn(rows, target, percent, 20, longest, 500)


@pytest.mark.parametrize("pivots", [1, 31])
def test_quickselect(spark, pivots, monkeypatch):
    """Any k, with many ties in every column and whole keys that repeat."""
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    rng = random.Random(3)
    keys = [(rng.randrange(4), rng.randrange(5), rng.randrange(3)) for _ in range(150)]
    df = spark.createDataFrame(keys, "a long, b long, c long").cache()
    for k in (1, 2, 75, 149, 150) if pivots > 1 else (1, 100):
        assert resampling.kth(df, k, ["a", "b", "c"]) == sorted(keys)[k - 1]
    same = spark.createDataFrame([(1, 1, 1)] * 40, "a long, b long, c long")
    assert resampling.kth(same, 17, ["a", "b", "c"]) == (1, 1, 1)


def test_ranks_have_no_gaps(spark, small):
    docs, aims = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = resampling.resampled(docs, aims, 50).collect()
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == [*range(1, len(ranked) + 1)] and ranked
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked)
    assert np.mean([r.weight for r in ranked]) > np.mean([r.weight for r in got])


def test_empty(spark):
    docs, aims = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert not resampling.resampled(docs, aims).collect()
    some = spark.createDataFrame([(k, "word " * 30) for k in range(20)], "doc_id long, text string")
    got = resampling.resampled(some, aims).collect()
    assert len(got) == 20 and sorted(r.rank for r in got if r.rank) == [1, 2] and len({r.weight for r in got}) == 1

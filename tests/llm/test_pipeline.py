"""The pipeline's stages, each on what its predecessor kept."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import pytest
from test_operators import SCHEMA, words_of
from cartograin.llm import quality_classifier
from cartograin.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, small):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, small), "stage")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()} if k < 4 else docs.collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    verdicts = quality_classifier.classified(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    assert kept[0] == {r.doc_id: texts[r.doc_id] for r in verdicts.collect() if r.kept}
    sets, parent = {i: shingles(t) for i, t in kept[0].items()}, {i: i for i in kept[0]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert kept[1] == {i: t for i, t in kept[0].items() if root(i) == i}
    seen = {}
    assert kept[2].keys() == kept[1].keys()
    for i in sorted(kept[1]):
        w = WORD.findall(kept[1][i])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        assert WORD.findall(kept[2][i]) == [x for x, g in zip(w, gone) if not g] and (any(gone) or kept[2][i] == kept[1][i])
    assert kept[3].keys() == kept[2].keys() and not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in kept[3].values())
    tokens = collections.Counter()
    for r in kept[4]:
        tokens[r.doc_id] += r.length
    assert tokens == {r.doc_id: r.doc_tokens for r in kept[4]} and tokens.keys() == kept[3].keys()
    assert len({hashlib.md5(t.encode()).digest() for t in kept[1].values()}) == len(kept[1])


def odd_rows():
    rng = random.Random(12)
    base, passage = words_of(rng, 90), words_of(rng, 30)
    texts = [base, base, None, "", " \n ", "one", passage + " " + passage, words_of(rng, 40) + "\n" + passage, "x " * 70, words_of(rng, 4000), "mail a.b@c.example.org now " + words_of(rng, 30)]
    rows = [*enumerate(texts), (None, base), (None, None), (None, base), (0, base), (3, words_of(rng, 50))]
    return rows


@pytest.mark.parametrize("stage", range(5))
def test_each_stage_on_odd_rows(spark, small, stage):
    """Nulls in any column, empty and long texts, repeats, rows without an id, and columns with names that stages use themselves."""
    rows = odd_rows()
    clash = SCHEMA.replace("label string", "failed string").replace("blocks string", "component_id string")
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, None if i is None else 7, *["clash"] * 12) for i, t in rows], clash)
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, small)
    found = got.collect()
    if stage == 4:
        assert sum(r.length for r in found) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in found}[r.doc_id, r.doc_tokens] * (r.start == 0) for r in found)
        return
    assert got.columns == docs.columns
    left, all_ = collections.Counter(r.doc_id for r in found), collections.Counter(i for i, _ in rows)
    assert all(r.n_chars == (7 if stage < 2 and r.doc_id is not None else r.n_chars) for r in found)
    if stage in (2, 3):
        assert left == all_ and all((r.text is None) or r.n_chars == len(r.text) for r in found)
        assert sum(r.text is None for r in found) == sum(t is None for _, t in rows)
    else:
        assert not left - all_ and left[None] == all_[None]
    if stage == 1:
        assert 0 in left and 1 not in left and left[2] == 1


@pytest.mark.parametrize("stage", range(5))
def test_each_stage_on_an_empty_table(spark, small, stage):
    empty = spark.createDataFrame([], SCHEMA)
    got = corpus_pipeline.STAGES[stage][1](spark, empty, small)
    assert not got.collect() and (stage == 4 or got.columns == empty.columns)

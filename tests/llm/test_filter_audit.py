"""The filter audit against brute force: the transducer byte by byte, the hash table, and all orders of the filters."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import SCHEMA, words_of

from cartograin.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet=st.sampled_from("aAbZ #$|\n\téß漢🤦  "), max_size=700), max_size=5)


def measured(text):
    w = WORD.findall(text)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_measures(texts):
    got = filter_audit.measures(pa.array([*texts, None], pa.string()))
    assert got.tolist() == [measured(t) for t in [*texts, ""]]


def test_long_text():
    rng = random.Random(1)
    text = words_of(rng, 400_000)
    assert filter_audit.measures(pa.array(["a", text, "", "b b"])).tolist() == [measured(t) for t in ("a", text, "", "b b")]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With one hash for all words, only the comparison of bytes is left."""
    monkeypatch.setattr(filter_audit, "mix", lambda x: x & np.uint64(0))
    text = "ab ba ab bb aa ba"
    assert filter_audit.measures(pa.array([text, "ab ab"])).tolist() == [measured(text), measured("ab ab")]


def audited(rows, labels):
    """Plain restatement, document by document and order by order."""
    fails = {}
    for k, (i, text, lang) in enumerate(rows):
        text = text or ""
        n, distinct, capitals, chars, symbols = measured(text)
        own = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * chars, "D": symbols > 0}
        own["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails[k] = {f for f in own if own[f]}
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[c] == 1} for c in (0, 1))
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in fails[k]}
                redundant = sum(f in fails[k] for k in mine if k not in left)
                left -= gone
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(fails[k] == {f} for k in mine), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return out


def odd_rows():
    rng = random.Random(2)
    texts = [None, "", " \n", "ABC", "a $", words_of(rng, 120), words_of(rng, 120) + " %", " ".join(f"w{k}" for k in range(150)), "SHOUT " * 110, " ".join(f"W{k}" for k in range(120))]
    rows = [(rng.choice([None, *range(40)]), t, rng.choice(["en", "de", None, ""])) for t in texts * 6]
    return rows + rows[:4]


def test_audit_by_brute_force(spark):
    rows = odd_rows()
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(30)] + [(None, 1, 1), (3, 0, 1), (7, None, None), (900, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, None, 0, *["clash"] * 12) for i, t, lang in rows], SCHEMA.replace("label string", "failed string"))
    found = filter_audit.audited(filter_audit.failures(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert dict(found.dtypes) == {**dict.fromkeys(("part", "filter_order"), "string"), "step": "int", **dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")}
    got = {tuple(r)[:3]: list(r)[3:] for r in found.collect()}
    assert got == audited(rows, labels)


@pytest.mark.parametrize("filters", ["ABCDE", "CD", "E"])
def test_surviving(spark, filters):
    rows = [(k, t) for k, (_, t, _) in enumerate(odd_rows())] + [(None, "ABC"), (None, " ".join(f"w{k}" for k in range(150)))]
    docs = spark.createDataFrame([(i, t, "en", None, 0, *["clash"] * 12) for i, t in rows], SCHEMA)
    left = filter_audit.surviving(docs, filters)
    assert left.columns == docs.columns

    def fails(i, text):
        n, distinct, capitals, chars, symbols = measured(text or "")
        own = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * chars, "D": symbols > 0, "E": i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t in rows)}
        return any(own[f] for f in filters)

    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter(r for r in rows if not fails(*r))


def test_empty(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not filter_audit.audited(filter_audit.failures(docs), labels).collect()
    one = spark.createDataFrame([(1, None, "en")], "doc_id long, text string, lang string")
    got = filter_audit.audited(filter_audit.failures(one), labels).collect()
    assert len(got) == 600 and {r.kept for r in got if r.filter_order[: r.step].find("A") >= 0} == {0}

"""The classifier's whole result against a plain restatement, and its exact quantiles."""

import collections
import functools
import math
import random

import corpus_pipeline
from pyspark.sql import functions as F

from cartograin.llm import quality_classifier

FOLDS, FEW, PRIOR, WORST = 4, 20, 40, 6


def grams(text, n=4):
    symbols = [2, 2, 2, *memoryview(text.encode("utf-16-le")).cast("H")]
    return [tuple(symbols[k : k + n]) for k in range(len(symbols) - n + 1)]


def model_of(texts):
    """The probability of a symbol after its context, by interpolated modified Kneser-Ney."""
    level = {4: collections.Counter(g for t in texts for g in grams(t))}
    for k in (3, 2, 1):
        level[k] = collections.Counter(g[1:] for g in level[k + 1])
    discounts, after = {}, {}
    for k, c in level.items():
        n, d = collections.Counter(c.values()), [0.5] * 3
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.5]
            d = [min(max(x, 0.1), j + 0.9) for j, x in enumerate(d)]
        discounts[k] = d
        for g, v in c.items():
            after.setdefault(g[:-1] if k > 1 else (), {})[g] = v

    @functools.cache
    def prob(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        of, less = after.get(g[:-1], {}), lambda v: discounts[len(g)][min(v, 3) - 1]
        if not of:
            return prob(g[1:])
        return (of.get(g, 0) - (less(of[g]) if g in of else 0) + sum(map(less, of.values())) * prob(g[1:])) / sum(of.values())

    return prob


def quantile_of(values, q):
    return sorted(values)[math.ceil(len(values) * q) - 1]


def restated(docs, folds, q):
    """{id: (perplexity, score, threshold, kept)}; docs: {id: (text, lang)} without null or empty texts, folds: {id: fold} of the trusted."""
    models = [model_of([docs[i][0] for i, f in folds.items() if f != k]) for k in range(FOLDS + 1)]
    lp = {i: [math.log(models[folds.get(i, 0)](g)) for g in grams(t)] for i, (t, _) in docs.items()}
    worst = {i: -max([0, *(-sum(x[k : k + WORST]) for k in range(max(1, len(x) - WORST + 1)))]) / -WORST for i, x in lp.items()}
    mean = lambda ids: -sum(sum(lp[i]) for i in ids) / sum(len(lp[i]) for i in ids)

    def own(lang, value):
        ids = [i for i in folds if docs[i][1] == lang]
        return ((len(ids) * value(ids) if ids else 0) + FEW * value([*folds])) / (len(ids) + FEW)

    score = {i: (PRIOR * own(docs[i][1], mean) - sum(x)) / (PRIOR + len(x)) for i, x in lp.items()}
    out = {}
    for i, (_, lang) in docs.items():
        limit = own(lang, lambda ids: quantile_of([score[j] for j in ids], q))
        worst_limit = own(lang, lambda ids: quantile_of([worst[j] for j in ids], q))
        final = max(score[i], worst[i] / worst_limit * limit)
        out[i] = math.exp(-sum(lp[i]) / len(lp[i])), final, limit, final <= limit
    return out


def test_classifier_is_made_of_all_trusted_texts(spark):
    rng = random.Random(11)
    text = lambda words: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))
    good, bad = ["river", "stone", "über", "and", "the", "𝄞 tone"], ["zzxq", "!!", "river", "0O0"]
    docs = {i: (text(good if i % 3 else bad), [None, "en", "de"][i % 7 % 3]) for i in range(40)}
    labels = [(i, int(i % 3 > 0), int(i % 10 == 1)) for i in range(0, 36)]
    trusted = spark.createDataFrame([(i,) for i, quality, toxic in labels if quality and not toxic], "id long")
    folds = {r.id: r.fold for r in trusted.select("id", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(FOLDS)) + 1).alias("fold")).collect()}
    assert set(folds.values()) == {1, 2, 3, 4}
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in docs.items()], "doc_id long, text string, lang string")
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    shuffled = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for q in (0.9, 0.5):
        want = restated(docs, folds, q)
        for threshold in ("-1", shuffled):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            try:
                got = quality_classifier.classified(table, flags, q).collect()
            finally:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", shuffled)
            assert sorted(r.doc_id for r in got) == [*docs]
            for r in got:
                perplexity, score, limit, kept = want[r.doc_id]
                assert r.n_symbols == len(grams(docs[r.doc_id][0])) and abs(r.perplexity / perplexity - 1) < 1e-5
                assert abs(r.score - score) < 1e-5 and abs(r.threshold - limit) < 1e-5 and (r.kept == kept or abs(score - limit) < 1e-5)
        assert {kept for *_, kept in want.values()} == {True, False}


def test_one_trusted_text_judges_no_other(spark):
    docs = spark.createDataFrame([(1, "one text", "en"), (2, "another", "en"), (3, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality_classifier.classified(docs, labels).collect()} == {1: True, 2: True, 3: False}


def test_limits_are_exact(spark):
    rows = spark.range(120_000, numPartitions=7).select(
        F.when(F.col("id") % 5 > 0, F.lit("en")).alias("lang"),
        (F.xxhash64("id") % 1_000_003).cast("double").alias("score"),
        (F.col("id") % 13).cast("double").alias("worst"),
    )
    of = collections.defaultdict(list)
    for r in rows.collect():
        of[False, r.lang].append(r)
        of[True, None].append(r)
    for q in (0.0, 0.5, 0.99, 1.0):
        got = {(r.whole, r.lang): r for r in quality_classifier._limits(rows, q).collect()}
        assert got.keys() == of.keys()
        for key, r in got.items():
            at = max(0, math.ceil(len(of[key]) * q) - 1)
            assert (r.limit, r.worst_limit, r.held) == (sorted(x.score for x in of[key])[at], sorted(x.worst for x in of[key])[at], len(of[key]))


def test_pipeline_keeps_what_all_trusted_texts_allow(spark, tmp_path):
    rng = random.Random(12)
    text = lambda words: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 25)))
    docs = {i: (text(["river", "stone", "and", "the"] if i % 3 else ["zzxq", "!!", "the", "0O0"]), "en") for i in range(40)}
    trusted = spark.createDataFrame([(i,) for i in range(36) if i % 3], "id long")
    folds = {r.id: r.fold for r in trusted.select("id", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(FOLDS)) + 1).alias("fold")).collect()}
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in docs.items()], "doc_id long, text string, lang string")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(36)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = restated(docs, folds, 0.99)
    got = {r.doc_id for r in corpus_pipeline.quality(spark, table, str(tmp_path)).collect()}
    clear = {i for i, (_, score, limit, _) in want.items() if abs(score - limit) > 1e-5}
    assert len(clear) >= 30 and got & clear == {i for i in clear if want[i][3]} and 0 < len(got) < len(docs)


def test_thresholds_of_the_pipeline_hang_on_no_sketch(spark, tmp_path, monkeypatch):
    """What an approximate quantile says, however far off, changes nothing: each threshold is found among the values of all trusted texts."""
    rng = random.Random(13)
    text = lambda words: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 25)))
    docs = {i: (text(["river", "stone", "and", "the"] if i % 3 else ["zzxq", "!!", "the", "0O0"]), [None, "en"][i % 2]) for i in range(40)}
    trusted = spark.createDataFrame([(i,) for i in range(36) if i % 3], "id long")
    folds = {r.id: r.fold for r in trusted.select("id", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(FOLDS)) + 1).alias("fold")).collect()}
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in docs.items()], "doc_id long, text string, lang string")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(36)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("percentile_approx", "approx_percentile"):
        monkeypatch.setattr(F, name, lambda x, of, *_: F.transform(F.array(F.min(x), F.min(x)), lambda v: v - 1))
    want = restated(docs, folds, 0.99)
    got = {r.doc_id for r in corpus_pipeline.quality(spark, table, str(tmp_path)).collect()}
    clear = {i for i, (_, score, limit, _) in want.items() if abs(score - limit) > 1e-5}
    assert len(clear) >= 30 and got & clear == {i for i in clear if want[i][3]} and 0 < len(got) < len(docs)


def test_limits_of_close_and_signed_values(spark):
    """Thresholds that differ from their neighbours in the last bit, below and above zero, one language of a single row."""
    near = [math.nextafter(x, math.inf) for x in (-2.5, -2.5e-300, 0.0, 1.0, 3.7)]
    values = sorted([-math.inf, -2.5, *near, 1.0, 3.7, 3.7, math.inf])
    rows = spark.createDataFrame([("en", x, -x) for x in values] + [(None, 0.25, -0.25)], "lang string, score double, worst double").repartition(5)
    for q in (0.0, 0.1, 0.3, 0.5, 0.75, 0.9, 1.0):
        got = {(r.whole, r.lang): r for r in quality_classifier._limits(rows, q).collect()}
        assert got.keys() == {(True, None), (False, "en"), (False, None)}
        for key, own in (((False, "en"), values), ((False, None), [0.25]), ((True, None), sorted([*values, 0.25]))):
            at = max(0, math.ceil(len(own) * q) - 1)
            assert (got[key].limit, got[key].worst_limit, got[key].held) == (own[at], -own[-1 - at], len(own))

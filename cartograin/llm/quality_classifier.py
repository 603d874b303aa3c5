"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and quantiles by language.

Symbols are UTF-16 units, n is 4, so an n-gram is a 64-bit number and a text has three start symbols before it. Counts of
the trusted texts are summed by Spark; lower orders count distinct left neighbours; discounts D1, D2, D3+ come from the
counts of counts of each order. The model stays sharded: documents are packed into units of about UNIT characters, each
unit asks once for each n-gram that it holds, joins on n-grams and contexts give their probabilities from order 1 upwards,
and the answers go back to the units, where they are summed for each document. Units lie in buckets, so that their texts are
not shuffled. All trusted texts make the model; they fall into FOLDS folds, and each is itself scored by a model of the other
folds, so that none is judged by a model that was made of it. A language's threshold is a high quantile of the scores of all
its trusted texts. Two things are scored: the mean negative log probability, drawn towards the language's mean as by PRIOR
symbols more, so that a few words alone do not condemn a short text, and the worst run of WORST symbols, so that a few toxic
words are not averaged away in a long one. Each has its quantile of the trusted texts; the run is put on the mean's scale, so
that one threshold judges the greater of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, fresh, mix, ranges_for, removed, table, written

ORDER = 4
#: Characters of a unit, and of the texts that are cut into n-grams at a time.
UNIT, CHUNK = 8 << 20, 1 << 19
#: Folds of the trusted texts. Model 0 is of all folds, model k of all but fold k.
FOLDS = 4
PRIOR = 40
#: Symbols of a run: about a word, and more than one n-gram that the trusted texts never have.
WORST = 6
#: Bits of a threshold that are found at a time.
DIGIT = 16
_START = "\x02" * (ORDER - 1)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of texts, and which text each is of."""
    parts = [np.frombuffer((_START + t).encode("utf-16-le"), np.uint16) for t in texts]
    lengths = np.array([len(p) for p in parts])
    x = np.concatenate(parts).astype(np.uint64)
    g = np.zeros(len(x), np.uint64)
    for k in range(ORDER):
        g[ORDER - 1 :] = g[ORDER - 1 :] << np.uint64(16) | x[k : len(x) - ORDER + 1 + k]
    whole = np.ones(len(x), bool)
    heads = np.cumsum(lengths) - lengths
    for k in range(ORDER - 1):
        whole[heads + k] = False
    return g[whole].view(np.int64), np.repeat(np.arange(len(texts)), lengths)[whole]


def _runs(texts):
    """(first, texts) of runs of about CHUNK characters."""
    first, held, size = 0, [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def _units(docs: DataFrame) -> DataFrame:
    """One row per unit: its number, and of its documents ids, languages, byte lengths and the packed texts."""

    def pack(batches):
        from pyspark import TaskContext

        def row(held, k):
            texts = [t for *_, t in held]
            columns = [[(base << 24) | k], [[h[0] for h in held]], [[h[1] for h in held]], [[len(t) for t in texts]], [zstandard.ZstdCompressor(level=6).compress(b"".join(texts))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["unit", "ids", "langs", "sizes", "z"])

        base, held, size, k = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            for i, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                held.append((i, lang, (text or "").encode()))
                size += len(held[-1][2])
                if size >= UNIT:
                    yield row(held, k)
                    held, size, k = [], 0, k + 1
        if held:
            yield row(held, k)

    return docs.select("id", "lang", "text").mapInArrow(pack, "unit long, ids array<long>, langs array<string>, sizes array<long>, z binary")


def _unpacked(sizes: list[int], z: bytes):
    """The texts of a unit, one at a time."""
    raw, at = memoryview(zstandard.ZstdDecompressor().decompress(z)), 0
    for n in sizes:
        yield str(raw[at : at + n], "utf-8")
        at += n


def _folds(n: int, places: pa.Table) -> np.ndarray:
    """The fold of each of a unit's n texts, 0 if it is not trusted."""
    folds = np.zeros(n, np.int8)
    folds[places.column("at").to_numpy()] = places.column("fold").to_numpy()
    return folds


def _grams_by_fold(texts, folds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of 0 to FOLDS the different n-grams of the texts of that fold, sorted, and how often each occurs."""
    found = [[] for _ in range(FOLDS + 1)]
    for first, run in _runs(texts):
        own, which = _grams(run)
        of = folds[first : first + len(run)][which]
        for k in np.unique(of):
            found[k].append(np.unique(own[of == k], return_counts=True))
    out = []
    for parts in found:
        g, which = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in parts)]), return_inverse=True)
        out.append((g, np.bincount(which, np.concatenate([np.zeros(0), *(c for _, c in parts)]), minlength=len(g)).astype(np.int64)))
    return out


def _counted(units: DataFrame, places: DataFrame) -> DataFrame:
    """(model, g, c): how often the texts of each model have each n-gram. places: (unit, at, fold) of all trusted texts."""

    def count(units: pa.Table, places: pa.Table) -> pa.Table:
        g, folds, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for sizes, z in zip(*(units.column(x).to_pylist() for x in ("sizes", "z"))):
            fold = _folds(len(sizes), places)
            texts = (t for t, k in zip(_unpacked(sizes, z), fold) if k)
            for k, (own, often) in enumerate(_grams_by_fold(texts, fold[fold > 0])):
                g.append(own)
                folds.append(np.full(len(own), k, np.int32))
                c.append(often)
        return pa.table({"g": np.concatenate(g), "fold": np.concatenate(folds), "c": np.concatenate(c)})

    found = units.groupBy("unit").cogroup(places.groupBy("unit")).applyInArrow(count, "g long, fold int, c long")
    own = lambda k: F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0))
    by_fold = found.groupBy("g").agg(F.array(F.sum("c"), *(F.sum("c") - own(k) for k in range(1, FOLDS + 1))).alias("of"))
    return by_fold.select(F.posexplode("of").alias("model", "c"), "g").filter("c > 0").select("model", "g", "c")


def _range(g: np.ndarray, model: int, ranges: int) -> np.ndarray:
    """The range of each n-gram by its hash: of one model alone, and ascending with the models."""
    share = -(-ranges // FOLDS)
    first, n = (ranges + (model - 1) * share, share) if model else (0, ranges)
    return (first + mix(g.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _unit_grams(sizes: list[int], z: bytes, folds: np.ndarray, ranges: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each model the n-grams that a unit asks of it, each once, and the range of each; in the order of ranges, then n-grams."""
    out = []
    for k, (g, _) in enumerate(_grams_by_fold(_unpacked(sizes, z), folds)):
        r = _range(g, k, ranges)
        order = np.argsort(r, kind="stable")
        out.append((g[order], r[order]))
    return out


def _asked(units: DataFrame, places: DataFrame, ranges: int) -> DataFrame:
    """(r, unit, g): the n-grams of each unit, packed by range of their hash; in range -1 the folds of its texts."""

    def ask(units: pa.Table, places: pa.Table) -> pa.Table:
        rs, of, packed = [], [], []
        for unit, sizes, z in zip(*(units.column(x).to_pylist() for x in ("unit", "sizes", "z"))):
            folds = _folds(len(sizes), places)
            g, r = (np.concatenate(x) for x in zip(*_unit_grams(sizes, z, folds, ranges)))
            cuts = np.flatnonzero(np.diff(r, prepend=-1))
            rs += [-1, *r[cuts].tolist()]
            packed += [folds.tobytes(), *(p.tobytes() for p in (np.split(g, cuts[1:]) if len(cuts) else []))]
            of += [unit] * (1 + len(cuts))
        return pa.table({"r": pa.array(rs, pa.int32()), "unit": pa.array(of, pa.int64()), "g": pa.array(packed, pa.binary())})

    units = units.select("unit", "sizes", "z")
    return units.groupBy("unit").cogroup(places.groupBy("unit")).applyInArrow(ask, "r int, unit long, g binary")


def _discounts(counts: DataFrame) -> list[list[float]]:
    """Of each model the discounts of n-grams that occur once, twice, and more often."""
    n = {(r["model"], r["c"]): r["count"] for r in counts.filter("c <= 4").groupBy("model", "c").count().collect()}
    out = []
    for model in range(FOLDS + 1):
        n1, n2, n3, n4 = (n.get((model, k), 0) for k in (1, 2, 3, 4))
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
            out.append([min(max(d, 0.1), k + 0.9) for k, d in enumerate(found)])
        else:
            out.append([0.5, 0.5, 0.5])
    return out


def _probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(model, g, p) for each asked (model, g) (g of counts and asked is of ORDER symbols); without the column model all is of one.

    Tables of counts and of shorter n-grams are removed once used.
    """
    if "model" not in counts.columns:
        return _probabilities(counts.withColumn("model", F.lit(0)), asked.withColumn("model", F.lit(0))).drop("model")
    tail = lambda c, k: F.col(c).bitwiseAND((1 << 16 * k) - 1) if k < ORDER else F.col(c)
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy("model", tail("g", k).alias("g")).agg(F.count("*").alias("c")), "kneser-ney-counts")
    p = None
    symbols = dict(levels[1].groupBy("model").count().collect())
    even = F.array(*(F.lit(1.0 / (symbols.get(m, 0) + 1)) for m in range(FOLDS + 1)))
    for k in range(1, ORDER + 1):
        d = F.array(*(F.lit(x) for of in _discounts(levels[k]) for x in of))
        less = F.get(d, F.col("model") * 3 + F.least("c", F.lit(3)).cast("int") - 1)
        of = levels[k].select("model", "g", "c", less.alias("less"), F.shiftrightunsigned("g", 16).alias("h"))
        rest = of.groupBy("model", "h").agg(F.sum("c").alias("total"), F.sum("less").alias("spare"))
        own = of.select("model", "g", (F.col("c") - F.col("less")).alias("own"))
        wanted = asked if k == ORDER else asked.select("model", tail("g", k).alias("g")).distinct()
        wanted = wanted.withColumn("h", F.shiftrightunsigned("g", 16)).join(own, ["model", "g"], "left").join(rest, ["model", "h"], "left")
        if p is None:
            wanted = wanted.withColumn("lower", F.get(even, F.col("model")))
        else:
            wanted = wanted.withColumn("tail", tail("g", k - 1)).join(p.select("model", F.col("g").alias("tail"), F.col("p").alias("lower")), ["model", "tail"])
        value = F.when(F.col("total").isNull(), F.col("lower")).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("spare") * F.col("lower")) / F.col("total"))
        lower, p = p, written(wanted.select("model", "g", value.alias("p")), "kneser-ney-probabilities")
        removed(levels[k])
        if lower is not None:
            removed(lower)
    return p


def _worst(lp: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts the greatest mean negative log probability of WORST symbols on end; a shorter text is filled up with zeros."""
    out = np.bincount(which, -lp, minlength=n) / WORST
    if len(lp) >= WORST:
        summed = np.concatenate(([0.0], np.cumsum(-lp)))
        runs, of = (summed[WORST:] - summed[:-WORST]) / WORST, which[: len(lp) - WORST + 1]
        runs, of = runs[of == which[WORST - 1 :]], of[of == which[WORST - 1 :]]
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        if len(heads):
            out[of[heads]] = np.maximum.reduceat(runs, heads)
    return out


def _scored(units: DataFrame, p: DataFrame, asked: DataFrame, ranges: int) -> DataFrame:
    """(id, lang, fold, n, lp, worst): symbols, log probability and worst run of each document, by its model."""

    def place(batches):
        for b in batches:
            model, g = b.column(0).to_numpy(), b.column(1).to_numpy()
            r = np.zeros(len(g), np.int32)
            for k in np.unique(model):
                r[model == k] = _range(g[model == k], int(k), ranges)
            yield pa.RecordBatch.from_arrays([pa.array(r), *b.columns[1:]], ["r", "g", "p"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        g, lp = known.column("g").to_numpy(), np.log(known.column("p").to_numpy()).astype(np.float32)
        order = np.argsort(g)
        g, lp = g[order], lp[order]
        answers = [lp[np.searchsorted(g, np.frombuffer(x, np.int64))].tobytes() for x in asked.column("g").to_pylist()]
        return pa.table({"unit": asked.column("unit"), "r": asked.column("r"), "lp": pa.array(answers, pa.binary())})

    def score(units: pa.Table, answers: pa.Table) -> pa.Table:
        told = answers.sort_by("r").column("lp").to_pylist()
        tables = []
        for ids, langs, sizes, z in zip(*(units.column(c).to_pylist() for c in ("ids", "langs", "sizes", "z"))):
            folds, lp, at, models = np.frombuffer(told[0], np.int8), np.frombuffer(b"".join(told[1:]), np.float32), 0, []
            for g, _ in _unit_grams(sizes, z, folds, ranges):
                order = np.argsort(g)
                models.append((g[order], lp[at : at + len(g)][order].astype(np.float64)))
                at += len(g)
            n, total, worst = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            for first, run in _runs(_unpacked(sizes, z)):
                own, which = _grams(run)
                of, each = folds[first : first + len(run)][which], np.zeros(len(own))
                for k in np.unique(of):
                    g, known = models[k]
                    each[of == k] = known[np.searchsorted(g, own[of == k])]
                n[first : first + len(run)] = np.bincount(which, minlength=len(run))
                total[first : first + len(run)] = np.bincount(which, each, minlength=len(run))
                worst[first : first + len(run)] = _worst(each, which, len(run))
            tables.append(pa.table({"id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "fold": folds.astype(np.int32), "n": n, "lp": total, "worst": worst}))
        return pa.concat_tables(tables) if tables else pa.table({"id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "fold": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "lp": pa.array([], pa.float64()), "worst": pa.array([], pa.float64())})

    known = p.select("model", "g", "p").mapInArrow(place, "r int, g long, p double")
    answers = asked.filter("r >= 0").groupBy("r").cogroup(known.groupBy("r")).applyInArrow(answer, "unit long, r int, lp binary")
    answers = answers.unionByName(asked.filter("r < 0").select("unit", "r", F.col("g").alias("lp")))
    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(score, "id long, lang string, fold int, n long, lp double, worst double")


def _limits(rows: DataFrame, quantile: float) -> DataFrame:
    """(whole, lang, limit, worst_limit, held): the quantiles of score and worst, by language and (whole) of all rows, and how many rows.

    A quantile is the least value that at least that share of the rows does not exceed. It is found by its bits, DIGIT at a
    time from the highest: all values that agree with it so far are counted by their next bits, and the count at which its
    rank is reached says which it has. So all values are counted, none is estimated, and no count is of more than 2^DIGIT kinds.
    """

    def ordered(batches):
        for b in batches:
            bits = b.column(3).to_numpy(zero_copy_only=False).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))], ["whole", "lang", "kind", "x", "bits"])

    of = lambda whole: F.struct(F.lit(whole).alias("whole"), F.when(~F.lit(whole), F.col("lang")).alias("lang"))
    kinds = F.explode(F.array(F.struct(F.lit("limit").alias("kind"), F.col("score").alias("x")), F.struct(F.lit("worst_limit").alias("kind"), F.col("worst").alias("x"))))
    rows = rows.select("score", "worst", F.explode(F.array(of(True), of(False))).alias("of")).select("of.*", kinds.alias("k")).select("whole", "lang", "k.*")
    rows = rows.mapInArrow(ordered, "whole boolean, lang string, kind string, x double, bits long")
    group = ["whole", "lang", "kind"]
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("digits"))
    same = lambda at: F.col("whole").eqNullSafe(at.whole_) & F.col("kind").eqNullSafe(at.kind_) & F.col("lang").eqNullSafe(at.lang_)
    at = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        near = rows if at is None else rows.join(at, same(at) & (F.shiftright("bits", shift + DIGIT) == F.col("digits_")))
        counts = near.groupBy(*group, *([] if at is None else ["held", "rank"]), F.shiftright("bits", shift).alias("digits")).agg(F.count("*").alias("n"), F.min("x").alias("x"))
        if at is None:
            counts = counts.withColumn("held", F.sum("n").over(Window.partitionBy(*group))).withColumn("rank", F.greatest(F.ceil(F.col("held") * quantile), F.lit(1)))
        found = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        found = found.select(*group, "digits", "x", "held", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
        before, at = at, written(found.withColumnsRenamed({c: f"{c}_" for c in (*group, "digits", "x")}), "classifier-limits")
        if before is not None:
            removed(before)
    limit = lambda kind: F.max(F.when(F.col("kind_") == kind, F.col("x_"))).alias(kind)
    return at.groupBy(F.col("whole_").alias("whole"), F.col("lang_").alias("lang"), "held").agg(limit("limit"), limit("worst_limit")).select("whole", "lang", "limit", "worst_limit", "held")


def classified(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, few: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, score, threshold, kept) of each row of docs.

    Trusted are all documents that labels (doc_id, quality, toxic) has with quality 1 and toxic 0: all make the model, and
    all set the thresholds. Each is scored by the model of the other folds (by hash of its id), all other documents by the
    model of all. kept is whether score is at most the threshold of the language, the quantile of its trusted texts (a null
    language is one of its own); the mean and the quantiles of a language are weighted by its trusted texts, those of all
    languages as by few texts more, so one with hardly any is judged like the others. The worst run counts in score times
    the ratio of the mean's quantile to its own, so of trusted texts at most twice the share beyond the quantile is rejected.
    Where trusted texts are not in two folds at least, so that none can be scored, all texts that are not empty are kept.
    Null and empty texts have no perplexity and are not kept. Rows without an id are scored like others; repeated rows are
    scored each. Other columns are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    trusted = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    trusted = trusted.withColumn("fold", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(FOLDS)) + 1).cast("int"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    units = bucketed(_units(docs), "classifier_units", "unit")
    places = units.select("unit", F.posexplode("ids").alias("at", "id")).join(trusted, "id")
    places = written(places.select("unit", "at", "fold"), "classifier-places")
    ranges = ranges_for(spark, (units.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0) // 4)
    counts = written(_counted(units, places), "kneser-ney-counts")
    asked = written(_asked(units, places, ranges), "classifier-asked")

    def distinct(t: pa.Table) -> pa.Table:
        g = np.unique(np.frombuffer(b"".join(t.column("g").to_pylist()), np.int64))
        r = t.column("r")[0].as_py()
        return pa.table({"model": np.full(len(g), 0 if r < ranges else 1 + (r - ranges) // -(-ranges // FOLDS), np.int32), "g": g})

    grams = written(asked.filter("r >= 0").select("r", "g").groupBy("r").applyInArrow(distinct, "model int, g long"), "classifier-grams")
    p = _probabilities(counts, grams)
    removed(grams)
    scored = written(_scored(units, p, asked, ranges), "classifier-scored")
    # a model of no text gives nothing less than 1
    held_out = scored.filter("fold > 0 and n > 0 and lp < 0")
    means = held_out.groupBy("lang").agg((-F.sum("lp") / F.sum("n")).alias("mean"), F.count("*").alias("held"))
    mean = held_out.agg(-F.sum("lp") / F.sum("n")).first()[0]
    by_lang = means.select(F.col("lang").alias("lang_"), "mean", "held")
    scored = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    held = F.coalesce("held", F.lit(0))
    own = lambda c, whole: (held * F.coalesce(c, F.lit(whole)) + few * F.lit(whole).cast("double")) / (held + few)
    middle = F.coalesce(own("mean", mean), -F.col("lp") / F.col("n"))
    scored = scored.withColumn("score", F.when(F.col("n") > 0, (PRIOR * middle - F.col("lp")) / (PRIOR + F.col("n"))))
    scored = written(scored.select("id", "lang", "fold", "n", "lp", "worst", "score"), "classifier-scored")
    limits = written(_limits(scored.filter("fold > 0 and n > 0 and lp < 0"), quantile), "classifier-limits")
    overall, worst_overall = limits.filter("whole").select("limit", "worst_limit").first() or (None, None)
    limits = limits.filter("not whole").select(F.col("lang").alias("lang_"), "limit", "worst_limit", "held")
    scored = scored.join(limits, F.col("lang").eqNullSafe(F.col("lang_")), "left").withColumn("threshold", own("limit", overall))
    as_mean = F.col("worst") / own("worst_limit", worst_overall) * F.col("threshold")
    scored = scored.withColumn("score", F.when(F.col("n") > 0, F.greatest("score", as_mean)))
    kept = (F.col("n") > 0) & F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True))
    return scored.select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_symbols"), F.when(F.col("n") > 0, F.exp(-F.col("lp") / F.col("n"))).alias("perplexity"), "score", "threshold", kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """The rows of docs that classified() keeps, and rows without an id; an id that any of its rows keeps stays. Columns as in docs."""
    key = fresh(docs.columns, name="_key")
    found = classified(docs, labels, quantile)
    gone = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("kept")).filter("not kept").select(key)
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and verdict of each document, by a model of the labelled ones. Nulls and repeats as classified() says."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Each operator against brute force, on the smallest tables and on rows with nulls, ties, repeats and clashing columns."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartograin.llm import bpe, fingerprints, ngram_jaccard_join, packing, pii, quality_classifier, quality_rules, sharding, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, h string, id string, rep string, shard string, part string, unit string, _key string, key string, n string, blocks string, text_ string"


def words_of(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "x1", "Ünï"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = words_of(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = words_of(rng, 30)
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one", "one two", "ONE  two", passage, words_of(rng, 40) + "\n" + passage + " tail", passage + " " + passage, "x " * 70, words_of(rng, 6000)]
    texts += ["mail a.b@c.example.org or +1 (372) 555-2373, 10.0.0.256 and 10.0.0.255; 4111 1111 1111 1111."] * 2
    out = [(k, t) for k, t in enumerate(texts)]
    return out + [out[2], (None, base), (None, None), (50, words_of(rng, 80))]


@pytest.fixture(scope="module")
def edge(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s" if i else None, 0, *["clash"] * 12) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def shingles(text, width):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + min(width, len(w))]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components_of(rows, width, num, den):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t, width)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_components(documents, edge, rows, block, monkeypatch):
    monkeypatch.setattr(ngram_jaccard_join, "BLOCK", block)
    plain = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    for df, of, args in ((documents, plain, (4, 85, 100)), (documents, plain, (2, 50, 100)), (edge, rows, (5, 80, 100))):
        got = ngram_jaccard_join.jaccard_components(df, *args).collect()
        assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == components_of(of, *args)
        assert len(got) == len(of) and all(r[2] is None for r in got if r[0] is None)


def test_one_of_each(edge, rows):
    kept = ngram_jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns
    roots = components_of(rows, 5, 80, 100)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and roots[i][1] == i)


def test_linked_by_divide_skip():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = []
    for k in range(60):
        own = base.copy()
        own[rng.choice(len(own), rng.integers(0, 60), replace=False)] = rng.integers(1 << 61, 1 << 62)
        sets.append(np.unique(own)[: rng.integers(150, 301)])
    first = ngram_jaccard_join.linked(sets, 85, 100)
    want = components_of([], 1, 1, 1)
    parent = [*range(len(sets))]
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert want == {} and first.tolist() == parent


def kept_words(rows, window):
    """(n_words, n_removed, kept_sha256) of each (id, text); ids that are equal or missing take nothing from each other."""
    docs = {(i if i is not None else math.inf, t or "") for i, t in rows}
    first = {}
    for i, t in docs:
        w = WORD.findall(t)
        for k in range(len(w) - window + 1):
            at = tuple(w[k : k + window])
            first[at] = min(i, first.get(at, math.inf))
    out = {}
    for i, t in docs:
        w, own = WORD.findall(t), set()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            at = tuple(w[k : k + window])
            if first[at] < i or at in own:
                gone[k : k + window] = [True] * window
            own.add(at)
        out[None if i == math.inf else i, t] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def clashing(spark):
    """Texts that share an id or have none, some with passages of other rows."""
    rng = random.Random(8)
    a, b, c = (words_of(rng, 40) for _ in range(3))
    own = [words_of(rng, 45) for _ in range(4)]
    rows = [(7, a + " " + own[0]), (7, own[1]), (7, own[1]), (7, "x " + a), (None, a + " " + own[2]), (None, own[3] + " " + b), (None, b), (None, c + " " + c), (3, "y " + b), (9, own[1] + "\n\n" + a), (None, None)]
    return rows, spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, key string, id string")


def test_repeated_words(documents, edge, rows, clashing):
    plain = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    for df, of in ((documents, plain), (edge, rows), clashing[::-1]):
        want = kept_words(of, 20)
        got = collections.Counter(tuple(r) for r in substring_dedup.repeated_words(df).collect())
        assert got == collections.Counter((i, *want[i, t or ""]) for i, t in of)


def test_longest_repeats(spark):
    rng = random.Random(3)
    passages = [words_of(rng, n) for n in (11, 24, 50, 90, 200, 340)]
    rows = [(2 * k + j, words_of(rng, 30) + " " + p + " " + words_of(rng, 30 + j)) for k, p in enumerate(passages) for j in (0, 1)]
    rows += [(90, passages[2] + " of the " + passages[2]), (91, words_of(rng, 60)), (92, words_of(rng, 60))] + [(93, passages[5])] * 2
    got = {r.doc_id: r.longest_repeat for r in substring_dedup.longest_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [WORD.findall(t) for _, t in rows]

    def longest(k):
        """The longest run of text k that stands elsewhere, or elsewhere in it."""
        n, w = 0, texts[k]
        for s in range(len(w)):
            while s + n < len(w) and any(o[x : x + n + 1] == w[s : s + n + 1] for j, o in enumerate(texts) for x in range(len(o) - n) if j != k or x != s):
                n += 1
        return n

    for k, (i, _) in enumerate(rows):
        n = longest(k)
        assert got[i] <= n and (got[i] == len(texts[k]) or got[i] >= max([x for x in (10, 20, 40, 80, 160) if 2 * x <= n], default=0)), (i, got[i], n)
    assert got[93] == 340 and got[91] == 0 and got[10] >= 160


@pytest.mark.parametrize("width", [1, 2, 5, 8, 11])
def test_least_of_each_run(width):
    x = np.random.default_rng(1).integers(0, 9, 60)
    assert substring_dedup._least(x, width).tolist() == [k + int(np.argmin(x[k : k + width])) for k in range(60 - width + 1)]


def test_without_repeats(edge, rows, clashing):
    for df, of in ((edge, rows), clashing[::-1]):
        got = substring_dedup.without_repeats(df)
        assert got.columns == df.columns
        want = kept_words(of, 20)
        found = collections.Counter((r.doc_id, None if r.text is None else hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest()) for r in got.collect())
        assert found == collections.Counter((i, None if t is None else want[i, t][2]) for i, t in of)


def test_personal_data(documents, edge, rows):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def spans(text):
        out = []
        for kind, p in patterns:
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                odd = sum(int(x) for x in digits[-1::-2]) + sum((2 * int(x)) % 9 if x != "9" else 9 for x in digits[-2::-2])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and odd % 10 == 0 or kind == "phone" and 8 <= len(digits) <= 15:
                    out.append((kind, m.start(), m.end()))
        return out

    plain = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    for df, of in ((documents, plain), (edge, rows)):
        got = sorted(pii.personal_data(df).collect(), key=lambda r: (r[0] is None, r[0]))
        assert len(got) == len(of)
        want = {i: t for i, t in of}
        bases = [(i, ",".join(f"{k}:{a}:{b}" for k, a, b in spans(t or ""))) for i, t in of]
        assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == collections.Counter((i, hashlib.sha256(b.encode()).hexdigest()) for i, b in bases)
        for r in got:
            if sum(i == r.doc_id for i, _ in of) > 1:
                continue
            found = spans(want[r.doc_id] or "")
            base = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in found) for k in pii.KINDS]
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (r.spans == base or r.spans.startswith(base + ","))


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@x.y", "a@b", "a@b.c.", "1.2.3.4.5.6.7.8", "1.2.3", "999.1.1.1 1.1.1.1", "9" * 5000, "1.2.3." + "0" * 5000, "+1" + "(" * 100 + "2", "4111-1111 11111111", "+12345678 +1-2", "%@a.b", "a..b@c-d.e-f.g"])
def test_base_spans(text):
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+){3}")):
        want = [m.span() for m in re.finditer(p, text) if kind == "email" or all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))] if len(text) < 1000 else None
        got = [x[:2] for x in pii.base_spans(text)[kind]]
        assert want is None or got == want


def test_sanitisation_of_telling_terms(spark):
    rng = random.Random(2)
    rows = [(k, words_of(rng, 30)) for k in range(60)]
    rows += [(100 + k, words_of(rng, 12) + f" zanzibar a.b@mail.example.org beta{k} " + words_of(rng, 12)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    for i, t in rows:
        added = [t[int(s) : int(e)] for k, s, e in (x.split(":") for x in spans[i].split(",") if x) if k in ("removed", "generalised")]
        assert ("zanzibar" in added) == (i >= 100) and "beta" not in added
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == rows[0][1] and "zanzibar" not in clean[100] and "<EMAIL>" in clean[100] and "example.org" not in clean[100]


def test_sanitisation_of_single_mentions(spark, small):
    rng = random.Random(4)
    rows = [(k, words_of(rng, 30)) for k in range(200)]
    rows += [(300, "zanzibar " + words_of(rng, 20) + " a.b@mail.example.org " + words_of(rng, 20) + "\nmadagascar")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = [rows[-1][1][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[300].split(",")) if k in ("removed", "generalised")]
    assert "zanzibar" in added and not {"alpha", "beta", "the", "madagascar"} & set(added) and not any(got[k] for k in range(200))
    given = pii.personal_data(spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")).collect()
    kinds = collections.Counter(x.split(":")[0] for r in given for x in r.spans.split(",") if x)
    assert kinds["removed"] + kinds["generalised"] > 0 and all(r.n_email + r.n_ip + r.n_card + r.n_phone for r in given if "removed" in r.spans or "generalised" in r.spans)
    print(kinds)


def added_spans(texts, general=4.0, removed=2.0):
    """The spans that the corpus adds to each distinct text, by plain counting."""
    term, lines, held, n_e, n_et = re.compile(r"[A-Za-z\x80-\U0010ffff]+"), {}, collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        spans = [(s, e, (k, v)) for k, own in pii.base_spans(t).items() for s, e, v in own]
        terms = [(m.start(), m.end(), m[0].encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))) for m in term.finditer(t)]
        held.update({w for *_, w in terms})
        lines[t] = []
        for s, e, entity in spans:
            low, high = t.rfind("\n", 0, s) + 1, t.find("\n", e) if "\n" in t[e:] else len(t)
            lines[t] += [(entity, w, a, b) for a, b, w in terms if low <= a < high and len(w) >= 3 and not any(x < b and a < y for x, y, _ in spans)]
        n_e.update({entity for entity, *_ in lines[t]})
        n_et.update({(entity, w) for entity, w, *_ in lines[t]})
    out = {}
    for t in texts:
        out[t] = {}
        for entity, w, a, b in lines[t]:
            m, p = held[w], n_et[entity, w] / held[w]
            left, of = -math.log2((p + 0.5 / m - math.sqrt(p * (1 - p) / m + 0.25 / m / m)) / (1 + 1 / m)), math.log2(len(texts) / n_e[entity])
            if left <= general and of - left >= of / 4 and of > 0:
                out[t][a, b] = max(out[t].get((a, b), ""), "removed" if left <= removed else "generalised")
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "odd"])
def test_added_spans_by_brute_force(documents, edge, rows, scale):
    df, texts = (documents, {r[1] or "" for r in documents.select("doc_id", "text").collect()}) if scale != "odd" else (edge, {t or "" for _, t in rows})
    want = added_spans(texts)
    by_id = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
    assert any(want.values())
    for r in pii.personal_data(df).collect():
        found = {(int(s), int(e)): k for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k in ("removed", "generalised")}
        assert any(want[t or ""] == found for i, t in by_id if i == r.doc_id)


def test_verdicts_do_not_turn_with_the_size_of_the_corpus(spark):
    rng = random.Random(9)
    base = [(k, f"zanzibar a.b@mail{k}.example.org madagascar{'abc'[k % 3]} alpha") for k in range(6)]
    kinds = []
    for n in (100, 3000):
        docs = spark.createDataFrame([*base, *((100 + k, words_of(rng, 12)) for k in range(n))], "doc_id long, text string")
        kinds.append({r.doc_id: r.spans for r in pii.personal_data(docs).filter("doc_id < 100").collect()})
    assert kinds[0] == kinds[1] and "generalised:0:8" in kinds[0][0] and "removed:" not in kinds[0][0]


def test_redacted_terms():
    assert pii.redact("Rosa meets a.b@c.de in jail", "email:11:19,generalised:0:4,generalised:5:10,removed:20:22") == "<NAME> <TERM> <EMAIL>  jail"


def test_copies_of_a_text_do_not_hide_its_terms(spark):
    rng = random.Random(6)
    rows = [(k, words_of(rng, 30)) for k in range(300)] + [(1000 + k, f"zanzibar x{k} a.b@mail.example.org alpha") for k in range(3)]
    alone = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    copies = spark.createDataFrame(rows + [(2000 + k, rows[-1][1]) for k in range(500)] + [(3000 + k, None) for k in range(9)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(copies.repartition(5)).collect()}
    assert "removed:0:8" in alone[1000] and all(got[i] == alone[i] for i in alone) and got[2499] == alone[1002] and got[3000] == ""
    once = pii._once(copies, spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(),) for t in (rows[-1][1], "")], "text_key string"))
    assert collections.Counter(r.text for r in once.collect()) == collections.Counter({t: 1 for t in [*(t for _, t in rows), ""]})


def test_bpe(documents, edge, rows):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(bpe.default_vocabulary())
    plain = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    odd = ["Hello  World's it'll 123 été ΣΑΣ", "a<|endoftext|>b <|STARTOFTEXT|> c", "İstanbul", "日本語 text🙂!!", "naïve café  x\x1cy", "don't 'S x'RE", "x\x00y <|startoftext|>", "éa Å ﬁ", "́ a", "x" * 300]
    own = bpe.WordBpe(bpe.default_vocabulary())
    for t in odd:
        e = full.encode(t, add_special_tokens=False).ids
        ids, text = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e and text == full.decode(e, skip_special_tokens=False) == own.decode(e)
    for df, of in ((documents, plain), (edge, rows)):
        want = collections.Counter()
        for i, t in of:
            e = full.encode(t or "", add_special_tokens=False).ids
            want[i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(full.decode(e, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert collections.Counter(tuple(r) for r in bpe.encoded(df, bpe.default_vocabulary()).collect()) == want


def test_quality_rules_against_sql(spark, documents, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got = sorted(tuple(r) for r in quality_rules.quality(documents).collect())
    assert got == sorted(con.sql(quality_rules.SQL).fetchall())


def test_quality_rules_by_hand(edge, rows):
    got = sorted(quality_rules.quality(edge).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    for r in got:
        t = next((t or "" for i, t in rows if i == r.doc_id and r.doc_id is not None), None)
        if t is None:
            continue
        w = WORD.findall(t)
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(wins)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        repeats = len({k + j for k, x in enumerate(wins) if n[x] > 1 for j in range(3)})
        assert r.n_repeat_words == repeats and r.base_failed == (len(w) < 50 or 100 * repeats > 50 * len(w))


def test_common_lines_are_removed(spark):
    rng = random.Random(1)
    rows = [(k, "s", words_of(rng, 60) + "\nClick here  to subscribe 1" + str(k)) for k in range(30)] + [(100, "s", "click here  to subscribe 7\n" * 3 + words_of(rng, 49)), (101, "s", words_of(rng, 60))]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[0].kept and got[0].n_common_words == 5 and got[101].kept and got[101].n_common_words == 0
    assert not got[100].base_failed and not got[100].kept and got[100].n_common_words == 15


def test_texts_without_common_lines(spark, edge):
    rng = random.Random(1)
    own = [words_of(rng, 60) for _ in range(30)]
    rows = [(k, "s", f"{t}\n\n Click here  to subscribe 1{k}\nend{'abcdefghijklmnopqrstuvwxyzABCD'[k]}{t[:3]}") for k, t in enumerate(own)]
    rows += [(100, "s", "click here  to subscribe 7\n" * 3 + words_of(rng, 49)), (101, "s", words_of(rng, 60)), (102, "t", own[0] + "\nclick here to subscribe 3"), (None, "s", rows[0][2]), (103, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = quality_rules.without_common_lines(docs)
    want = [(i, h, "\n".join(x for x in t.split("\n") if h != "s" or "Click here" not in x)) for i, h, t in rows if i not in (100, 103)]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want) and got.columns == docs.columns
    assert quality_rules.without_common_lines(edge).columns == edge.columns


def test_fingerprints(documents, edge, rows):
    def likeness(a, b):
        a, b = (collections.Counter(x.encode().lower().split()) for x in (a, b))
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    got = {r.doc_id: r for r in fingerprints.fingerprints(documents).collect()}
    ids, texts = sorted(got, reverse=True), {r[0]: r[1] for r in documents.select("doc_id", "text").collect()}
    errors = []
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i].near_edited - likeness(t, edited), got[i].near_next - likeness(t, after)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    by_text = {}
    odd = fingerprints.fingerprints(edge).collect()
    assert len(odd) == len(rows)
    for r in odd:
        if r.doc_id is not None:
            t = next(t or "" for i, t in rows if i == r.doc_id)
            assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and r.n_chars == len(t)


def test_classifier_separates_and_matches_brute_force(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.classified(documents, labels).collect()}
    texts = {r[0]: r[1] for r in documents.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    flags = {r.doc_id: r.quality for r in labels.collect()}
    good = [i for i in flags if flags[i]]
    assert sum(got[i].kept for i in good) >= 0.9 * len(good)
    assert sum(not got[i].kept for i in flags if not flags[i]) >= 0.6 * sum(not q for q in flags.values())


def test_classifier_rejects_toxic_texts(spark, small):
    larger = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    docs = docs.join(labels.withColumnRenamed("doc_id", "id_"), docs.doc_id == F.col("id_"))
    flags = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id: r.kept for r in quality_classifier.classified(docs, labels).collect()}
    insult = re.compile("clown|idiot|trash|stupid|pathetic|scum|moron|disgusting|worthless|loser", re.I)
    of = lambda quality, toxic: [i for i, r in flags.items() if (r.quality, r.toxic) == (quality, toxic)]
    gone = lambda ids: sum(not kept[i] for i in ids) / len(ids)
    seen = [i for i in of(1, 1) if insult.search(flags[i].text)]
    print(f"rejected: clean {gone(of(1, 0)):.3f}, quality 0 {gone(of(0, 0) + of(0, 1)):.3f}, quality 1 and toxic {gone(of(1, 1)):.3f}, with insults {gone(seen):.3f} of {len(seen)}")
    # the other toxic texts hold none of these words, nor anything else that trusted texts do not have
    assert gone(of(1, 0)) <= 0.03 and gone(of(0, 0) + of(0, 1)) >= 0.9 and gone(of(1, 1)) >= 0.6 and gone(seen) >= 0.95


def test_worst_run_of_each_text():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 5, 6, 7, 0, 40, 3]
    lp, which = -rng.random(sum(lengths)), np.repeat(np.arange(len(lengths)), lengths)
    got, w = quality_classifier._worst(lp, which, len(lengths)), quality_classifier.WORST
    for k, n in enumerate(lengths):
        own = -lp[which == k]
        assert abs(got[k] - max([own[j : j + w].sum() / w for j in range(max(1, n - w + 1))])) < 1e-9


def test_kneser_ney_probabilities(spark):
    texts = ["abab abba", "abcab", "bca bca b"]
    symbols = lambda t: [2, 2, 2, *t.encode("utf-16-le")[::2]]
    grams = lambda t, n=4: [tuple(symbols(t)[k : k + n]) for k in range(len(symbols(t)) - n + 1)]
    number = lambda g: sum(x << 16 * (len(g) - 1 - k) for k, x in enumerate(g))
    level = {4: collections.Counter(g for t in texts for g in grams(t))}
    for k in (3, 2, 1):
        level[k] = collections.Counter(g[1:] for g in level[k + 1])

    def prob(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        c = level[len(g)]
        n = collections.Counter(c.values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.5]
            d = [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]
        else:
            d = [0.5] * 3
        of = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not of:
            return prob(g[1:])
        less = lambda v: d[min(v, 3) - 1]
        return (of.get(g, 0) - (less(of[g]) if g in of else 0) + sum(map(less, of.values())) * prob(g[1:])) / sum(of.values())

    asked = sorted({g for t in [*texts, "xaby", "ca"] for g in grams(t)})
    counts = spark.createDataFrame([(number(g), c) for g, c in level[4].items()], "g long, c long")
    got = dict(quality_classifier._probabilities(counts, spark.createDataFrame([(number(g),) for g in asked], "g long")).collect())
    assert all(abs(got[number(g)] - prob(g)) < 1e-9 for g in asked) and len(got) == len(asked)
    context = asked[0][:3]
    assert abs(sum(prob((*context, x)) for (x,) in level[1]) + prob((*context, 9999)) - 1) < 1e-9


def test_classifier_edges(spark, edge, rows):
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (9, 1, 1), (10, 0, 0), (None, 1, 0), (50, 1, 0), (50, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classified(edge, labels).collect()
    assert len(got) == len(rows) and all(r.kept == (r.n_symbols > 0) or r.score > r.threshold for r in got)
    assert all(r.perplexity is None and not r.kept for r in got if not r.n_symbols)
    assert all(r.kept == (r.n_symbols > 0) for r in quality_classifier.classified(edge, labels.limit(0)).collect())
    assert quality_classifier.accepted(edge, labels).columns == edge.columns


def test_packing(documents, edge, rows):
    from tokenizers import Tokenizer

    paths = packing.default_tokenizer()
    full = Tokenizer.from_file(paths[0])
    plain = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    for df, of in ((documents, plain), (edge.dropDuplicates(["doc_id"]).filter("doc_id is not null"), [*{i: (i, t) for i, t in rows if i is not None}.values()])):
        ids = {i: full.encode(t or "", add_special_tokens=False).ids + [0] for i, t in of}
        pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.packed(df, paths, with_ids=True).collect():
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert r.ids == own and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            pieces[r.doc_id].append((r.start, r.length))
            seqs[r.sequence_id].append((r.offset, r.length, r.tier))
        for i in ids:
            at = 0
            for s, n in sorted(pieces[i]):
                assert s == at
                at += n
            assert at == len(ids[i])
        short = 0
        for parts in seqs.values():
            at = 0
            for o, n, tier in sorted(parts):
                assert o == at
                at += n
            short += at < parts[0][2]
            assert at <= parts[0][2]
        assert short <= 8


def test_packing_of_rows_without_or_with_one_id(edge, rows):
    """Null and repeated ids: every token of every row lies in one piece."""
    from tokenizers import Tokenizer

    paths = packing.default_tokenizer()
    full = Tokenizer.from_file(paths[0])
    want, of = collections.Counter(), collections.defaultdict(set)
    for i, t in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((i, len(ids), k) for k in range(len(ids)))
        of[i, len(ids)].add(tuple(ids))
    got = collections.Counter()
    for r in packing.packed(edge, paths, with_ids=True).collect():
        got.update((r.doc_id, r.doc_tokens, k) for k in range(r.start, r.start + r.length))
        assert any(list(ids[r.start : r.start + r.length]) == r.ids for ids in of[r.doc_id, r.doc_tokens])
    assert got == want


def test_step_groups_have_equal_tokens(documents):
    """A group has sequences of one tier, as many as STEP tokens take; only the last group of a tier in a task may have fewer."""
    tiers, sizes = collections.defaultdict(set), collections.defaultdict(set)
    for r in packing.packed(documents, packing.default_tokenizer()).collect():
        tiers[r.step_group].add(r.tier)
        sizes[r.step_group].add(r.sequence_id)
    assert all(len(t) == 1 for t in tiers.values())
    short = collections.Counter((g >> 33, *tiers[g]) for g in sizes if len(sizes[g]) * [*tiers[g]][0] < packing.STEP)
    assert all(len(sizes[g]) * [*tiers[g]][0] <= packing.STEP for g in sizes) and max(short.values()) == 1 and len(sizes) > len(short)


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b\n\n c", "don't I'll x 's", "é ü 日本 x", "a<|endoftext|> b", "x\x1c y\x85 z", "tab\t x", " nb sp"])
def test_chunked_tokens_are_the_library_s(text):
    own = packing.tokenizer(*packing.default_tokenizer())
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.full.encode(text, add_special_tokens=False).ids


def test_sequences_fill_gaps():
    rng = random.Random(4)
    docs = [(k, np.arange(rng.choice([3, 90, 200, 400, 700, 1024, 3000]), dtype="<u4").tobytes()) for k in range(300)]
    out = [*packing.sequences(docs, hold=40)]
    assert sum(sum(len(x) // 4 for *_, x in p) < t for t, p in out) <= 1 and {t for t, _ in out} > {512, 1024}
    assert sum(len(x) for _, p in out for *_, x in p) == sum(len(x) for _, x in docs)


PAGES = [(3, "http://a", "<p>x</p>"), (1, "http://b\n", "<p>x</p>"), (7, None, None), (8, "u", ""), (9, "u", "WARC/1.1\r\n\r\nfake é"), (1, "http://b", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, "u", "lonely")]


def test_warc_round_trip(spark, small, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    for k, df in enumerate((pages, spark.read.parquet(f"{small}/pages.parquet"), pages.limit(0))):
        warc.write_warc(df, f"{tmp_path}/{k}", records_per_file=3)
        got = warc.read_warc(spark, f"{tmp_path}/{k}", with_payload=True).collect() if df.count() else []
        assert all(r.kind == "record" for r in got)
        first = {}
        for r in df.collect():
            body = (r.html or "").encode()
            first[body] = min(x for x in (first.get(body), r.page_id, math.inf) if x is not None)
        want = collections.Counter()
        for r in df.collect():
            body = (r.html or "").encode()
            again = first[body] not in (r.page_id, math.inf)
            want[r.page_id, len(body), warc.digest(body), "revisit" if again else "response", first[body] if again else None, None if again else body] += 1
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got) == want


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    rng = random.Random(8)
    records = [(warc.record(k, "u", (t := f"page {k} WARC/1.1 \r\n\r\nWARC/1.1" * 5).encode(), warc.digest(t.encode()), len(t), None) + "\r\n").encode() for k in range(30)]
    parts = [gzip.compress(r) for r in records] if packed else records
    for _ in range(30):
        data, hurt = bytearray(b"".join(parts)), {}
        ends = np.cumsum([len(p) for p in parts])
        for k in rng.sample(range(30), 3):
            at = int(ends[k]) - len(parts[k]) + rng.randrange(4, len(parts[k]) - 5)
            data[at] ^= 0x55
            hurt[k] = at
        found = [*warc.salvage(bytes(data))]
        assert sum(x[2] for x in found if x[0] == "gap") + sum(x[2] for x in found if x[0] == "record") == len(data)
        ids = {x[3]["warc-record-id"] for x in found if x[0] == "record"}
        assert all(f"<urn:page:{k}>" in ids for k in range(30) if k not in hurt)


def test_read_warc_takes_plain_and_gzip_archives(spark, tmp_path):
    records = [(warc.record(k, "http://e.org", b"page %d" % k, warc.digest(b"page %d" % k), 6, None) + "\r\n").encode() for k in range(4)]
    damaged = [records[0], records[1].replace(b"page 1", b"PAGE 1"), records[2], records[3]]
    packed = [gzip.compress(x) for x in records]
    packed[1] = packed[1][:-6] + b"\x00" * 6
    (tmp_path / "a.warc").write_bytes(b"".join(damaged))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(packed))
    (tmp_path / "c.txt").write_bytes(records[1])
    (tmp_path / "d.html").write_bytes(records[1])
    got = warc.read_warc(spark, str(tmp_path), True).collect()
    for name, size, want in (("a.warc", sum(map(len, damaged)), [0, None, 2, 3]), ("b.warc.gz", sum(map(len, packed)), [0, None, 2, 3]), ("c.txt", len(records[1]), [1])):
        own = sorted((r for r in got if r.file.endswith("/" + name)), key=lambda r: r.offset)
        assert [r.page_id for r in own] == want and sum(r.length for r in own) == size
        assert all((r.kind == "gap") == (r.page_id is None) and (r.kind == "gap" or r.payload == b"page %d" % r.page_id) for r in own)
    assert not any(r.file.endswith("d.html") for r in got) and {r.file[-5:] for r in warc.read_warc(spark, str(tmp_path), names_like="*.warc").collect()} == {".warc"}


@pytest.mark.parametrize("packed", [False, True])
def test_damaged_headers_never_end_the_read(spark, tmp_path, packed):
    """Each byte of a record's header flipped, and numbers that no header may hold: the record goes or stays, the others stay."""
    middle = warc.record(1, "http://e.org", b"", warc.digest(b"page"), 4, 0) + "\r\n"
    ends = [(warc.record(k, "http://e.org", b"page", warc.digest(b"page"), 4, None) + "\r\n").encode() for k in (0, 2)]
    raw = middle.encode()
    damaged = [raw[:k] + bytes([raw[k] ^ flip]) + raw[k + 1 :] for k in range(raw.index(b"\r\n\r\n") + 4) for flip in (0x01, 0x20, 0x80)]
    swaps = [("X-Payload-Length: 4", "X-Payload-Length: 3x"), ("X-Payload-Length: 4", "X-Payload-Length: " + "9" * 30), ("urn:page:1>", "urn:page:99999999999999999999>"), ("urn:page:0>", "urn:page:-9999999999999999999>"), ("X-Payload-Length: 4", "X-Payload-Length: \u0664"), ("Content-Length: ", "Content-Length: -")]
    damaged += [middle.replace(a, b).encode() for a, b in swaps]
    assert all(d != raw for d in damaged)
    for k, d in enumerate(damaged):
        parts = [ends[0], d, ends[1]]
        parts = [gzip.compress(x) for x in parts] if packed else parts
        (tmp_path / f"{k:05d}.warc").write_bytes(b"".join(parts))
        found = [*warc.salvage(b"".join(parts))]
        assert sum({x[1]: x[2] for x in found}.values()) == sum(map(len, parts))
    rows = warc.read_warc(spark, str(tmp_path)).filter("kind = 'record'").groupBy("file").agg(F.collect_set("page_id").alias("ids")).collect()
    assert len(rows) == len(damaged) and all({0, 2} <= {*r.ids} for r in rows)
    bad = [r for r in warc.read_warc(spark, str(tmp_path), names_like=f"*{{{','.join(f'{k:05d}' for k in range(len(damaged) - len(swaps), len(damaged)))}}}.warc").collect() if r.kind == "gap"]
    assert len({r.file for r in bad}) == len(swaps) and {r.reason for r in bad} == {"bad header"}


def test_shards(documents, edge, rows):
    plain = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    for df, of in ((documents, plain), (edge, rows)):
        got = sharding.shards_by_bytes(df).collect()
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in of)
        slots, loads, texts = collections.defaultdict(list), collections.Counter({k: 0 for k in range(8)}), {}
        for r in got:
            slots[r.shard].append(r.slot)
            loads[r.shard] += r.size
            assert texts.setdefault((r.size, r.text_crc32), r.shard) == r.shard  # rows without an id as well
        assert all(sorted(x) == [*range(len(x))] for x in slots.values())
        largest = max(sum(n for n in collections.Counter({t or "": len((t or "").encode()) + 1}).values()) for _, t in of)
        assert max(loads.values()) - min(loads.values()) <= max(largest, 3 * max(len((t or "").encode()) + 1 for _, t in of))


def test_large_first_is_lpt():
    loads = [0] * 3
    at = sharding._large_first([(7, "a"), (7, "b"), (6, "c"), (5, "d"), (4, "e")], loads)
    assert sorted(loads) == [7, 11, 11] and at["a"] != at["b"]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        ngram_jaccard_join.jaccard_components(empty),
        ngram_jaccard_join.one_of_each(empty),
        substring_dedup.repeated_words(empty),
        substring_dedup.without_repeats(empty),
        pii.personal_data(empty),
        pii.sanitised(empty),
        bpe.encoded(empty, bpe.default_vocabulary()),
        quality_rules.quality(empty),
        fingerprints.fingerprints(empty),
        quality_classifier.classified(empty, labels),
        quality_classifier.accepted(empty, labels),
        packing.packed(empty, packing.default_tokenizer()),
        sharding.shards_by_bytes(empty),
    ):
        assert df.collect() == []

"""PII by patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Base spans are emails, IP addresses, card and phone numbers; their values are the protected entities. How strongly a term
reveals an entity is estimated from the corpus, over distinct texts: N in all, n(e) that mention the entity, n(t) with the
term, n(e, t) with the term on a mention's line. IC(e) = log2(N / n(e)) bits make out the entity. pmi(t, e) of them the term
gives, so left = IC - pmi = -log2 p(e | t) bits keep it apart from the others; p is not n(e, t) / n(t) but the lower bound of
Wilson's interval of one standard error for it, since most terms are rare. A term on the line of an entity's mention is
generalised if at most so many bits are left, and removed if still fewer are, provided that it gives a quarter of the bits at least
(which only matters for entities of very many texts). So verdicts hang on counts of the term and the entity, not on the size
of the corpus. Terms are runs of letters, compared by a 64-bit hash of their bytes (A-Z as a-z).
"""

from __future__ import annotations

import re
from hashlib import blake2b, md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, mix, ranges_for, table, word_hashes, written

KINDS = ("email", "ip", "card", "phone")
#: Letters that a term has at least.
LETTERS = 3
#: Share of an entity's information that a term gives at least.
GIVEN = 0.25
#: Distinct (term, count) pairs that a task gathers before it hands them on.
FLUSH = 1 << 20
#: Bits of the map of texts that have copies, and of a block of it.
MAP, BLOCK = 24, 15
#: Terms of a text, as the number of ranges takes it: tasks sum before they deal, so it may be small.
TERMS = 16
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
#: What separates terms: all of ASCII but letters.
NOT_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int, str]]]:
    """Of each kind the leftmost spans that do not overlap and pass their checks, with the entity's value."""
    found = {k: [] for k in KINDS}
    for s, e in _emails(text):
        found["email"].append((s, e, text[s:e].lower()))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            found["ip"].append((*m.span(), ".".join(p or "0" for p in parts)))
    for kind, pattern, least, most in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if least <= len(digits) <= most and (kind != "card" or _luhn(digits)):
                found[kind].append((*m.span(), digits))
    return found


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _entity(kind: str, value: str) -> int:
    return int.from_bytes(blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _around(text: str, spans: dict) -> list[tuple[int, int, int, int]]:
    """(entity, term, start, end) of the terms on each mention's line, outside all base spans."""
    mentions = [(s, e, _entity(k, v)) for k in KINDS for s, e, v in spans[k]]
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _, hashes = word_hashes(np.array([0, len(data)]), data, True, NOT_LETTER)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # bytes to code points
    lengths, starts, ends = ends - starts, points[starts], points[ends]
    free = lengths >= LETTERS
    for s, e, _ in mentions:
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e)
        free[a:b] = False
    out = set()
    for s, e, entity in mentions:
        line, after = text.rfind("\n", 0, s) + 1, text.find("\n", e)
        a, b = np.searchsorted(starts, line), np.searchsorted(starts, after if after >= 0 else len(text))
        k = a + np.flatnonzero(free[a:b])
        out.update(zip([entity] * len(k), hashes[k].view(np.int64).tolist(), starts[k].tolist(), ends[k].tolist()))
    return sorted(out, key=lambda x: (x[2], x[0]))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, text_key string, near array<struct<e: long, t: long, s: int, z: int>>"


def _found(docs: DataFrame) -> DataFrame:
    near = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("z", pa.int32())]))

    def find(batches):
        for b in batches:
            counts, shas, bases, keys, nears = [], [], [], [], []
            for text in b.column(1).to_pylist():
                spans = base_spans(text or "")
                base = _joined((k, s, e) for k in KINDS for s, e, _ in spans[k])
                counts.append([len(spans[k]) for k in KINDS])
                shas.append(sha256(base.encode()).hexdigest())
                bases.append(base)
                keys.append(md5((text or "").encode()).hexdigest())
                nears.append([dict(zip("etsz", x)) for x in _around(text, spans)] if base else None)
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, n.T), pa.array(shas, pa.string()), pa.array(bases, pa.string()), pa.array(keys, pa.string()), pa.array(nears, near)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "text_key", "near"])

    return docs.mapInArrow(find, _FOUND)


def _map(keys: DataFrame) -> DataFrame:
    """(b, bits): the places of text keys (text_key) in a map of 2^MAP bits, in blocks of 2^BLOCK: of a fixed size, so it can be broadcast."""

    def block(t: pa.Table) -> pa.Table:
        at = np.array([int(k[: MAP // 4], 16) for k in t.column("text_key").to_pylist()], np.int64)
        bits = np.zeros(1 << BLOCK, bool)
        bits[at & ((1 << BLOCK) - 1)] = True
        return pa.table({"b": pa.array([int(at[0]) >> BLOCK], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return keys.groupBy(F.shiftright(_place(F.col("text_key")), BLOCK).alias("of")).applyInArrow(block, "b long, bits binary")


def _place(key: Column) -> Column:
    return F.conv(F.substring(key, 1, MAP // 4), 16, 10).cast("long")


def _once(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """(text): each distinct text once; copied (text_key): those with copies. Only texts that share a bit with one of these are shuffled."""
    text = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    at = _place(F.col("key"))
    marked = text.withColumn("b", F.shiftright(at, BLOCK)).join(F.broadcast(_map(copied)), "b", "left")
    inside = at.bitwiseAND((1 << BLOCK) - 1)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shared = F.coalesce(byte.bitwiseAND(F.expr("element_at(array(128, 64, 32, 16, 8, 4, 2, 1), cast(place & 7 as int) + 1)")) != 0, F.lit(False))
    marked = marked.withColumn("place", at).withColumn("shared", shared).select("text", "key", "shared")
    again = marked.filter("shared").groupBy("key").agg(F.first("text").alias("text"))
    return marked.filter("not shared").select("text").unionByName(again.select("text"))


def _held(docs: DataFrame, copied: DataFrame, wanted: DataFrame, ranges: int) -> DataFrame:
    """(t, held): how many distinct texts have each wanted term; copied (text_key): the texts that have copies.

    Each task counts what it reads; ranges of the hash are summed.
    """

    def count(batches):
        def deal(parts):
            t, which = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            n = np.bincount(which, np.concatenate([x for _, x in parts])).astype(np.int64)
            r = (mix(t) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(r, kind="stable")
            cuts = np.flatnonzero(np.diff(r[order], prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(r[order][cuts]), *(pa.array([x[p].tobytes() for p in np.split(order, cuts[1:])], pa.binary()) for x in (t, n))], ["r", "t", "n"])

        parts, size = [], 0
        for b in batches:
            for _, offsets, data in chunks(b.column(0)):
                _, _, at, hashes = word_hashes(offsets, data, True, NOT_LETTER)
                if not len(hashes):
                    continue
                terms, which = np.unique(hashes, return_inverse=True)
                own = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * len(terms) + which) % len(terms)
                parts.append((terms, np.bincount(own, minlength=len(terms))))
                size += len(terms)
                if size >= FLUSH:
                    yield deal(parts)
                    parts, size = [], 0
        if parts:
            yield deal(parts)

    def add(counts: pa.Table, wanted: pa.Table) -> pa.Table:
        t, n = (np.frombuffer(b"".join(counts.column(c).to_pylist()), np.int64) for c in ("t", "n"))
        keys = np.sort(wanted.column("t").to_numpy())
        at = np.minimum(np.searchsorted(keys, t), max(len(keys) - 1, 0))
        hit = keys[at] == t if len(keys) else np.zeros(len(t), bool)
        return pa.table({"t": keys, "held": np.bincount(at[hit], n[hit], len(keys)).astype(np.int64) if len(keys) else pa.array([], pa.int64())})

    def placed(batches):
        for b in batches:
            r = (mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(ranges)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(r), b.column(0)], ["r", "t"])

    counts = _once(docs, copied).mapInArrow(count, "r int, t binary, n binary")
    wanted = wanted.mapInArrow(placed, "r int, t long")
    return counts.groupBy("r").cogroup(wanted.groupBy("r")).applyInArrow(add, "t long, held long")


def _spans(docs: DataFrame, general: float, removed: float, support: int) -> tuple[DataFrame, DataFrame]:
    """What _found() has for each row, and for each text key the spans (as text) that the corpus adds."""
    spark = docs.sparkSession
    found = written(_found(docs), "pii-found")
    near = found.filter("near is not null").select("text_key", F.explode("near").alias("x")).select("text_key", "x.*")
    mentions = near.select("e", "text_key").distinct().groupBy("e").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support)
    both = near.select("e", "t", "text_key").distinct().groupBy("e", "t").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support)
    both = written(both.join(mentions, "e"), "pii-both")
    texts = written(found.groupBy("text_key").agg(F.count("*").alias("rows")), "pii-texts")
    held = _held(docs, texts.filter("rows > 1").select("text_key"), both.select("t").distinct(), ranges_for(spark, TERMS * docs.count()))
    n = float(texts.count())
    p, m = F.col("n_et") / F.col("held"), F.col("held").cast("double")
    low = (p + 1 / (2 * m) - F.sqrt(p * (1 - p) / m + 1 / (4 * m * m))) / (1 + 1 / m)
    of = F.log2(F.lit(n) / F.col("n_e"))
    telling = both.join(held.filter("held > 0"), "t").withColumn("left", -F.log2(low)).filter((F.col("left") <= general) & (of - F.col("left") >= GIVEN * of) & (of > 0))
    telling = telling.select("e", "t", F.when(F.col("left") <= removed, F.lit("removed")).otherwise(F.lit("generalised")).alias("kind"))
    added = near.join(telling, ["e", "t"]).groupBy("text_key", "s", "z").agg(F.max("kind").alias("kind"))
    added = added.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "z"))).alias("x"))
    return found, added.select(F.col("text_key").alias("key_"), F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["z"].cast("string"))), ",").alias("added"))


def personal_data(docs: DataFrame, general: float = 4.0, removed: float = 2.0, support: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row; spans has base spans, then added ones.

    general and removed are the bits left of an entity's information up to which a term is generalised or removed (2 bits: a
    term of one text, or one most of whose texts mention the entity; 4 bits: one of up to six texts), support the distinct
    texts that must hold both. Null texts are empty. Ids are not looked at; rows with equal texts have equal
    spans. Other columns are ignored. An empty table gives an empty table. Texts are searched whole.
    """
    found, added = _spans(_plain(docs, id_col, text_col), general, removed, support)
    joined = found.join(added, found.text_key == added.key_, "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("added"))
    return joined.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def redact(text: str, spans: str) -> str:
    """The text with base spans as <KIND>, generalised terms as <NAME> (with a capital) or <TERM>, removed ones gone; of overlapping spans the first stays."""
    general = lambda s: "<NAME>" if text[s].isupper() else "<TERM>"
    out, at = [], 0
    for k, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))), key=lambda x: (x[1], -x[2])):
        if e > at:
            out += [text[at : max(s, at)], "" if k == "removed" else general(s) if k == "generalised" else f"<{k.upper()}>"] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, general: float = 4.0, removed: float = 2.0, support: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data replaced in the texts; all rows and columns stay, null texts stay null."""
    found, added = _spans(_plain(docs, id_col, text_col), general, removed, support)
    joined = found.join(added, found.text_key == added.key_, "left").filter("base <> '' or added is not null")
    spans = joined.groupBy("text_key").agg(F.first(F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("added"))).alias("spans"))
    key, with_spans, clean = (fresh(docs.columns, name=x) for x in ("_key", "_spans", "_clean"))
    spans = spans.withColumnsRenamed({"text_key": key, "spans": with_spans})
    replace = F.pandas_udf(lambda t, s: t.combine(s, lambda a, b: redact(a, b) if isinstance(a, str) and isinstance(b, str) else a), "string")
    joined = docs.join(spans, F.md5(docs[text_col].cast("binary")) == spans[key], "left")
    return joined.withColumn(clean, replace(F.col(text_col), F.col(with_spans))).withColumn(text_col, F.when(F.col(with_spans).isNull(), F.col(text_col)).otherwise(F.col(clean))).select(docs.columns)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data, and of the terms that give it away, of all documents. Nulls and repeats as personal_data() says."""
    return personal_data(table(spark, sf_dir, "documents"))

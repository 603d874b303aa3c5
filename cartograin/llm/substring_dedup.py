"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

The first level is half the window of removal. Of the half windows in each window the one with the smallest hash stands for
it (equal windows choose equal ones), so about a sixth of them need to be looked up, and no repeated window is missed. The
next level is that window: only windows whose half window is repeated are hashed and looked up, each with its place, and
what also starts earlier is removed. longest_repeats() doubles on from there with windows that stand for others in the same
way: a window of twice the length stays a candidate if all windows of the length in it did, and so on until none survives;
this gives the longest level at which a text repeats. Look-ups deal hashes over ranges of the hash; before that each task keeps
one posting of what it holds several times, so a passage that a third of all documents share gives each range a few only.

A row's key is a hash of its id and text. Rows of one id, or without an id, take nothing from each other, for none is
earlier. Windows count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALT, chunks, fresh, mix, ranges_for, removed, table, window_hashes, word_hashes, words, written

#: Postings that a task gathers before it hands them on.
FLUSH = 1 << 19
_KNOWN = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def _key(doc_id: int, text: bytes) -> int:
    return int.from_bytes(blake2b(text, digest_size=8, salt=doc_id.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _squeezed(docs: DataFrame) -> DataFrame:
    """Texts as zstd, and what is known of each alone: its key, n_words and the SHA-256 of its words joined by one space."""

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            keys, n, sha, z = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = (text.as_py() or "").encode()
                own = text.split()
                keys.append(_key(i, text))
                n.append(len(own))
                sha.append(sha256(b" ".join(own)).hexdigest())
                z.append(pack.compress(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(z, pa.binary())], ["id", "key", "n_words", "sha", "z"])

    return docs.mapInArrow(squeeze, "id long, key long, n_words long, sha string, z binary")


def _texts(column) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(z).decode() for z in column.to_pylist()], pa.large_string())


def _windows(offsets: np.ndarray, data: np.ndarray, window: int):
    """Of a chunk of texts: text and place of each window, its hash, its half window's hash and place in the chunk."""
    _, _, at, hashes = word_hashes(offsets, data)
    half, n = window // 2, len(hashes) - window + 1
    if n <= 0:
        return None
    halves = window_hashes(hashes, half)
    low, place = halves[:n].copy(), np.arange(n)
    for k in range(1, window - half + 1):
        less = halves[k : k + n] < low
        low[less] = halves[k : k + n][less]
        place[less] = np.flatnonzero(less) + k
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = np.flatnonzero(text[:n] == text[window - 1 :])
    return text[whole], whole - at[text[whole]], window_hashes(hashes, window)[whole], low[whole], place[whole]


def _dealt(r: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each value of r, with the bytes of each column's values there."""
    order = np.argsort(r, kind="stable")
    cuts = np.flatnonzero(np.diff(r[order], prepend=np.iinfo(np.int32).min))
    parts = [pa.array([x[p].tobytes() for p in np.split(order, cuts[1:])] if len(cuts) else [], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(r[order][cuts].astype(np.int32)), *parts], ["r", *columns])


def _repeated(rows: DataFrame, hashes: Callable, ranges: int, name: str) -> DataFrame:
    """(key, known): of each row's window hashes those that stand elsewhere too. hashes: from batches of rows to ones of (key, h), h a row's hashes as bytes."""

    def deal(hs, keys):
        h, i = np.concatenate(hs), np.concatenate(keys)
        order = np.argsort(h, kind="stable")
        h, i = h[order], i[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        single = new & np.append(new[1:], True)
        known = new & ~single
        r = (mix(h) % np.uint64(ranges)).astype(np.int64)
        back = -1 - (i % ranges)
        owner = np.where(known, _KNOWN, i)
        many = ~single
        return _dealt(np.concatenate((r[single | known], back[many])), {"h": np.concatenate((h[single | known], h[many])), "i": np.concatenate((owner[single | known], i[many]))})

    def look_up(batches):
        hs, keys, held = [], [], 0
        for b in hashes(batches):
            for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hs.append(np.frombuffer(h, np.uint64))
                keys.append(np.full(len(hs[-1]), i, np.int64))
                held += len(hs[-1])
                if held >= FLUSH:
                    yield deal(hs, keys)
                    hs, keys, held = [], [], 0
        if held:
            yield deal(hs, keys)

    def repeated(t: pa.Table) -> pa.Table:
        h, i = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("h", np.uint64), ("i", np.int64)))
        if t.column("r")[0].as_py() >= 0:
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            count[which[i == _KNOWN]] = 2
            keep = (count[which] > 1) & (i != _KNOWN)
            h, i = h[keep], i[keep]
        order = np.lexsort((h, i))
        h, i = h[order], i[order]
        new = np.ones(len(i), bool)
        new[1:] = i[1:] != i[:-1]
        cuts = np.flatnonzero(new)
        return pa.table({"key": i[cuts], "h": pa.array([x.tobytes() for x in np.split(h, cuts[1:])] if len(cuts) else [], pa.binary())})

    found = rows.mapInArrow(look_up, "r int, h binary, i binary").groupBy("r").applyInArrow(repeated, "key long, h binary")
    return written(found.groupBy("key").agg(F.collect_list("h").alias("known")), name)


def _halves(window: int) -> Callable:
    """From batches of (id, text) to ones of (key, h): the half windows that stand for the windows of each text."""

    def choose(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, offsets, data in chunks(b.column(1)):
                if not (found := _windows(offsets, data, window)):
                    continue
                text, _, _, low, place = found
                _, at = np.unique(place, return_index=True)
                cuts = np.searchsorted(text[at], np.arange(len(offsets)))
                own = [k for k in range(len(offsets) - 1) if cuts[k] < cuts[k + 1]]
                keys = [_key(ids[first + k], data[offsets[k] : offsets[k + 1]].tobytes()) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([low[at[cuts[k] : cuts[k + 1]]].tobytes() for k in own], pa.binary())], ["key", "h"])

    return choose


def _later(candidates: DataFrame, window: int, ranges: int) -> DataFrame:
    """(key, start, end): runs of words that windows cover whose words also start earlier. candidates: id, key, z, known."""

    def look_up(batches):
        def deal(parts):
            w, i, d, s, a = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((s, d, i, w))
            w, i, d, s, a = w[order], i[order], d[order], s[order], a[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])
            w, i, d, s, a = w[new], i[new], d[new], s[new], a[new]
            later = _behind(w, i, d)
            r = np.where(later, -1 - (d % ranges), (mix(a) % np.uint64(ranges)).astype(np.int64))
            return _dealt(r, {"w": w, "i": i, "d": d, "s": s})

        parts, held = [], 0
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            known = [np.frombuffer(b"".join(x), np.uint64) for x in b.column(3).to_pylist()]
            for first, offsets, data in chunks(_texts(b.column(2))):
                if not (found := _windows(offsets, data, window)):
                    continue
                text, start, w, low, _ = found
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                keep = np.concatenate([np.isin(low[cuts[k] : cuts[k + 1]], known[first + k]) for k in range(len(offsets) - 1)])
                parts.append((w[keep], ids[first + text[keep]], keys[first + text[keep]], start[keep].astype(np.int32), low[keep]))
                held += int(keep.sum())
                if held >= FLUSH:
                    yield deal(parts)
                    parts, held = [], 0
        if held:
            yield deal(parts)

    def runs(t: pa.Table) -> pa.Table:
        w, i, d, s = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("w", np.uint64), ("i", np.int64), ("d", np.int64), ("s", np.int32)))
        if t.column("r")[0].as_py() >= 0:
            order = np.lexsort((s, d, i, w))
            w, i, d, s = w[order], i[order], d[order], s[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])
            later = _behind(w[new], i[new], d[new])
            d, s = d[new][later], s[new][later]
        order = np.lexsort((s, d))
        d, s = d[order], s[order].astype(np.int64)
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + window)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(d))[: len(at)] - 1
        return pa.table({"key": d[at], "start": s[at], "end": s[last] + window})

    postings = candidates.select("id", "key", "z", "known").mapInArrow(look_up, "r int, w binary, i binary, d binary, s binary")
    return postings.groupBy("r").applyInArrow(runs, "key long, start long, end long")


def _behind(w: np.ndarray, i: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which windows (sorted by hash w, id i, key d, start) also start at a smaller id, or before in the same text."""
    if not len(w):
        return np.zeros(0, bool)
    low = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    head = np.repeat(low, np.diff(np.append(low, len(w))))
    again = np.zeros(len(w), bool)
    again[1:] = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    return (i != i[head]) | again


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the least (the leftmost of equal ones) of each width consecutive values."""
    order = np.argsort(x, kind="stable")
    low = np.empty(len(x), np.int64)
    low[order] = np.arange(len(x))
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    n = len(x) - width + 1
    return order[np.minimum(low[:n], low[width - step : width - step + n])]


def _extended(z: bytes, known: list[bytes], runs: list[tuple[int, int]] | None, length: int) -> tuple[list[tuple[int, int]], bytes] | None:
    """Of a text the runs of starts of candidate windows of four times the length, and the hashes of windows of twice the length that stand for them.

    A window of twice the length survives if one of the length that stands for it is known to be repeated (and if it is in
    runs); one of four times the length is a candidate if all of twice the length in it survive.
    """
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    hashes = word_hashes(np.array([0, len(data)]), data)[3]
    m = len(hashes) - 4 * length + 1
    if m <= 0:
        return None
    h = window_hashes(hashes, length)
    alive = np.isin(h[_least(h, length + 1)], np.frombuffer(b"".join(known), np.uint64))
    if runs is not None:
        alive &= _covered(runs, len(alive))
    gone = np.concatenate(([0], np.cumsum(~alive)))
    candidate = gone[2 * length + 1 : 2 * length + 1 + m] == gone[:m]
    if not candidate.any():
        return None
    double = window_hashes(hashes, 2 * length)
    edges = np.flatnonzero(np.diff(candidate.astype(np.int8), prepend=0, append=0)).tolist()
    return [*zip(edges[::2], edges[1::2])], double[np.unique(_least(double, 2 * length + 1)[candidate])].tobytes()


def _longest(candidates: DataFrame, window: int, ranges: int) -> DataFrame:
    """(key, longest): the longest level at which a window that stands for others is repeated. candidates: key, z, known."""

    def extend(length: int, first: bool):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def of(batches):
            for b in batches:
                runs = [None] * b.num_rows if first else [[(x["start"], x["end"]) for x in r] for r in b.column(3).to_pylist()]
                done = [(k, *found) for k, z, known, r in zip(*(c.to_pylist() for c in b.columns[:3]), runs) if (found := _extended(z, known, r, length))]
                columns = [pa.array([x[0] for x in done], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in done], kind), pa.array([x[2] for x in done], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "runs", "h"])

        return of

    length, texts = window // 2, candidates.select("key", "z")
    found = [candidates.select("key", F.lit(length).alias("longest"))]
    rows, before = candidates.select("key", "z", "known"), None
    while True:
        grown = written(rows.mapInArrow(extend(length, before is None), "key long, runs array<struct<start: int, end: int>>, h binary"), "substring-grown")
        if before is not None:
            removed(before)
        length, before = 2 * length, grown
        if not grown.limit(1).count():
            break
        known = _repeated(grown.select("key", "h"), iter, ranges, "substring-known")
        if not known.limit(1).count():
            break
        found.append(known.select("key", F.lit(length).alias("longest")))
        rows = texts.join(known, "key").join(grown.select("key", "runs"), "key").select("key", "z", "known", "runs")
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.max("longest").alias("longest"))


def _covered(pieces, n: int) -> np.ndarray:
    gone = np.zeros(n, bool)
    for start, end in pieces:
        gone[start:end] = True
    return gone


def _kept(z: bytes, pieces) -> tuple[int, bytes, str]:
    """Words removed, kept words joined by one space, and the text without removed words and the space behind each."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    starts, ends, _ = words(np.array([0, len(data)]), data)
    gone = _covered(pieces, len(starts))
    raw = data.tobytes()
    text, at = [], 0
    runs = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    for a, b in zip(runs[::2], runs[1::2]):
        text.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(raw)
    text.append(raw[at:])
    return int(gone.sum()), b" ".join(raw[s:e] for s, e in zip(starts[~gone], ends[~gone])), b"".join(text).decode()


def _search(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(id, key, n_words, sha, copied, copy) of each row; (id, key, z, known) of texts with candidates; (key, pieces) of what goes from them; the number of ranges."""
    if window < 2 or window % 2:
        raise ValueError("window must be even and 2 at least")
    squeezed = _squeezed(docs)
    alone = written(squeezed.select("id", "key", "n_words", "sha"), "substring-alone")
    ranges = ranges_for(docs.sparkSession, (alone.agg(F.sum("n_words")).first()[0] or 0) // 4)
    firsts = alone.filter(F.col("n_words") >= window).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    firsts = firsts.select("sha", "first", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    alone = alone.withColumn("salt", F.pmod("key", F.lit(SALT)).cast("int")).join(firsts, ["sha", "salt"], "left")
    alone = alone.select("id", "key", "n_words", "sha", F.col("first").isNotNull().alias("copied"), F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy"))
    alone = written(alone, "substring-alone")
    halves = _repeated(docs, _halves(window), ranges, "substring-known")
    halves = halves.join(alone.filter("copy").select("key").distinct(), "key", "left_anti")
    candidates = written(squeezed.select("id", "key", "z").join(halves, "key").dropDuplicates(["key"]).select("id", "key", "z", "known"), "substring-candidates")
    pieces = _later(candidates, window, ranges).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("pieces"))
    return alone, candidates, pieces, ranges


def _applied(candidates: DataFrame, pieces: DataFrame, texts: bool) -> DataFrame:
    def apply(batches):
        for b in batches:
            done = [_kept(z, [(x["start"], x["end"]) for x in p]) for z, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [b.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([sha256(x[1]).hexdigest() for x in done]), pa.array([x[2] if texts else None for x in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "gone", "left_sha", "left_text"])

    found = candidates.select("key", "z").join(pieces, "key").select("key", "z", "pieces").mapInArrow(apply, "key long, gone long, left_sha string, left_text string")
    return found.dropDuplicates(["key"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))


def repeated_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row.

    A word goes if a run of window words that covers it also starts earlier: in a row with a smaller id, or earlier in the
    same text. The doubling ends at window: there the place of each candidate is known, and none is left to extend. Texts
    that are null, empty or shorter than the window lose nothing. Rows without an id come after all others and, like rows
    of one id with different texts, take nothing from each other; rows of equal id and text have equal results. Other
    columns are ignored. An empty table gives an empty table.
    """
    alone, candidates, pieces, _ = _search(_keyed(docs, id_col, text_col), window)
    found = alone.join(_applied(candidates, pieces, False), "key", "left")
    return found.select(
        F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )


def longest_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, longest_repeat) of each row, by doubling until no candidate survives.

    longest_repeat is a level (window / 2, window, 2 window, ...) at which a run of so many words of the text stands elsewhere
    too, in another row or again in the text. It is the greatest such level or half of it: a run of twice a level is always
    found at the level. A text that stands twice (with window words or more) has its number of words, one without a run 0.
    Nulls, repeats and empty tables as repeated_words() says.
    """
    alone, candidates, _, ranges = _search(_keyed(docs, id_col, text_col), window)
    found = alone.join(_longest(candidates, window, ranges), "key", "left")
    longest = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("longest", F.lit(0))).cast("long")
    return found.select(F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), longest.alias("longest_repeat"))


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, each text without what repeated_words() removes and the space behind each such word; all rows and columns stay."""
    alone, candidates, pieces, _ = _search(_keyed(docs, id_col, text_col), window)
    left = _applied(candidates, pieces, True).filter("gone > 0").select("key", "left_text")
    copies = alone.filter("copy").select("key", F.lit("").alias("left_text")).distinct()
    key, text = fresh(docs.columns, name="_key"), fresh(docs.columns, name="_text")
    left = left.unionByName(copies).withColumnsRenamed({"key": key, "left_text": text})

    @F.pandas_udf("long")
    def keys(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_key(i, (t or "").encode()) for i, t in zip(ids, texts)], dtype="int64")

    joined = docs.withColumn(key, keys(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), F.col(text_col).cast("string"))).join(left, key, "left")
    return joined.withColumn(text_col, F.coalesce(F.col(text), F.col(text_col))).select(docs.columns)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What runs of 20 words that start earlier remove from each document. Nulls and repeats as repeated_words() says."""
    return repeated_words(table(spark, sf_dir, "documents"))


#: The same in DuckDB, with windows as text.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i+19], ' ') ORDER BY doc_id, i) AS k FROM w, unnest(range(1, greatest(len(words) - 18, 1))) AS t(i)),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM x, unnest(range(0, 20)) AS t(j) WHERE k > 1),
k AS (SELECT w.doc_id, t.p, w.words[t.p] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(p)),
r AS (SELECT k.doc_id, count(g.p) AS n_removed, coalesce(string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY k.p), '') AS kept FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""

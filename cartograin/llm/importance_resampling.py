"""Target-distribution importance resampling: documents like a target corpus, drawn by noisy scores and distributed quickselect.

1. Runs of words fall into buckets by crc32, which numpy computes for all words of a chunk at once, byte by byte. Spark adds
   up the buckets of all texts of both corpora; the driver gets one number a bucket and corpus and makes the array of gains.
2. A second pass sums each text's gains from that array and adds Gumbel noise, so the highest scores are a draw without
   replacement. Scores are written once.
3. Quickselect finds the k-th composite key (score, id, row): each round takes random pivot keys from what is open, counts
   exactly how many keys are below, at and above each, and goes on between two of them. Winners alone are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import numbered
from .common import _LOWER, chunks, table, words, written

BUCKETS = 10000
#: Bytes of a word that are taken in step with other words; a longer word goes on alone.
STEPS = 64
#: Pivot keys of a round.
PIVOTS = 31
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


_CRC = _crc_table()


def _onward(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers of crc32 after the spans' bytes, all in step."""
    order = np.argsort(np.minimum(lengths, STEPS + 1).astype(np.uint8), kind="stable")[::-1]
    crc, starts, lengths = crc[order], starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    left = len(lengths) - np.searchsorted(lengths[::-1] if longest <= STEPS else np.minimum(lengths, STEPS + 1)[::-1], np.arange(min(longest, STEPS)), "right")
    for k, n in enumerate(left):
        own = crc[:n]
        crc[:n] = _CRC[(own ^ data[starts[:n] + k]) & np.uint32(0xFF)] ^ own >> np.uint32(8)
    for i in range(int((lengths > STEPS).sum())):
        at = int(starts[i])
        crc[i] = zlib.crc32(data[at + STEPS : at + int(lengths[i])].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(column: pa.Array, longest: int = 1, buckets: int = BUCKETS):
    """(first row, words of each text, text of each feature, bucket of each feature) for successive runs of texts."""
    for first, offsets, data in chunks(column):
        starts, ends, at = words(offsets, data, _APART)
        data, counts = _LOWER[data], np.diff(at)
        owner, lengths = np.repeat(np.arange(len(counts)), counts), ends - starts
        crc = _onward(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
        texts, found = [owner], [crc ^ np.uint32(0xFFFFFFFF)]
        for n in range(1, longest):  # a run of n + 1 words: a run of n, a space, a word
            crc = crc[: max(0, len(starts) - n)]
            crc = _CRC[(crc ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
            crc = _onward(crc, data, starts[n:], lengths[n:])
            whole = owner[: len(crc)] == owner[n:]
            texts.append(owner[: len(crc)][whole])
            found.append(crc[whole] ^ np.uint32(0xFFFFFFFF))
        yield first, counts, np.concatenate(texts), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of texts (text), each task's sums added up by Spark."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, found in features(b.column(0), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    of_source, of_target = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: float(target.get(b, 0) + 1) * of_source / (float(source.get(b, 0) + 1) * of_target)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def _noise(doc_id: int, seed: int) -> int:
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of docs (doc_id, text); a row without an id has no score."""
    buckets = len(gain)

    def score(batches):
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for first, counts, texts, found in features(b.column(1), longest, buckets):
                own = slice(first, first + len(counts))
                n_words[own], n_features[own] = counts, np.bincount(texts, minlength=len(counts))
                np.add.at(weight[own], texts, gain[found])
            ids = b.column(0).to_pylist()
            scores = [None if i is None else int(w) + _noise(i, seed) for i, w in zip(ids, weight)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_features, weight)), pa.array(scores, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def _before(columns: list[str], key: tuple[int, ...]) -> Column:
    """Whether the row's composite key is less than key."""
    less = F.lit(False)
    for name, value in reversed([*zip(columns, key)]):
        less = (F.col(name) < value) | ((F.col(name) == value) & less)
    return less


def kth(keys: DataFrame, k: int, columns: list[str]) -> tuple[int, ...]:
    """The k-th composite key (k from 1, at most the rows) in ascending order of columns (long, no nulls), by quickselect.

    A round costs a pass that picks PIVOTS keys by a hash that changes from round to round, and one that counts keys below
    and at each of them; the driver gets these keys and counts. Rows with the same key count each.
    """
    low = high = None
    for turn in range(1 << 20):
        open_ = keys if low is None else keys.filter(~_before(columns, low) & ~_at(columns, low))
        open_ = open_ if high is None else open_.filter(_before(columns, high))
        drawn = open_.select(*columns).orderBy(F.xxhash64(*columns, F.lit(turn)), *columns).limit(PIVOTS).collect()
        pivots = sorted({tuple(r) for r in drawn})
        counts = open_.agg(*[F.count(F.when(test(columns, p), 1)) for p in pivots for test in (_before, _at)]).first()
        passed = 0
        for p, below, at in zip(pivots, counts[::2], counts[1::2]):
            if k <= below:
                high = p
                break
            if k <= below + at:
                return p
            low, passed = p, below + at
        k -= passed
    raise AssertionError("the open keys shrink in each round")


def _at(columns: list[str], key: tuple[int, ...]) -> Column:
    same = F.lit(True)
    for name, value in zip(columns, key):
        same = same & (F.col(name) == value)
    return same


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is null for those not drawn.

    Features are runs of 1 to longest words (a-z, 0-9 and beyond ASCII, A-Z lower-cased). weight sums the gains of its
    features' buckets towards the texts of target, score adds noise that seed and id decide. Of the N rows of least_words
    words or more, the floor(percent * N / 100) with the highest scores are drawn; ties go to the smaller id, rows of one id
    and score to the earlier in the written table. Null texts have no words and weight 0; rows without an id have no score
    and are not drawn, nor counted in N. Other columns are ignored. An empty table, of either side, is a corpus without
    features.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = [docs.select("text"), target.select(F.col(target_col).cast("string").alias("text"))]
    source, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(t, longest, buckets).collect()} for t in texts)
    rows = scored(docs, gains(source, wanted, buckets), longest, seed)
    rows = written(rows.withColumns({"row": F.monotonically_increasing_id(), "down": -F.col("score")}), "resampling-scores")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    keys, columns = rows.filter(able), ["down", "doc_id", "row"]
    k = percent * keys.count() // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    rank = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*shown, rank)
    last = kth(keys, k, columns)
    won = able & (_before(columns, last) | _at(columns, last))
    winners = numbered(rows.filter(won).select(*shown, *[c for c in columns if c not in shown]), *columns, name="place")
    return winners.select(*shown, (F.col("place") + 1).alias("rank")).unionByName(rows.filter(~F.coalesce(won, F.lit(False))).select(*shown, rank))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words or more, drawn towards benchmark. Nulls, ties and repeats as resampled() says."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB; crc32 by its table, over distinct words.
SQL = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) AS r(i))),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
e AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
f AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY doc_id, w),
g AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM e) GROUP BY w),
v AS (SELECT w, xor(list_reduce([('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT for k in range(octet_length(encode(w)))], lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), crc),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM g JOIN v USING (w) GROUP BY bucket),
b AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM f JOIN v USING (w) JOIN b USING (bucket) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * able) // 100 THEN place::BIGINT END AS rank FROM r
"""

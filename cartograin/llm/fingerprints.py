"""Document fingerprints by consistent weighted sampling.

Terms are words (A-Z as a-z), weighted by their counts. For each of the samples a term's hash gives r and c from Gamma(2, 1)
and b from U(0, 1); with weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r. The term of least a is the
sample, and (term, t) is the same in two texts with the probability of their generalised Jaccard similarity (sum of the
smaller over sum of the larger weights). ln a depends on the weight through t alone, so its bits stand for (term, t).
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, shuffle_parts, table, word_hashes

SAMPLES = 64
#: Code points of consecutive documents that a task fingerprints at a time (and one document more).
BLOCK = 4 << 20
_FIRST = -(1 << 63)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BITS = np.uint64((1 << 25) - 1)


def _log_a(terms: np.ndarray, weights: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = mix(terms ^ seed)
    y = mix(x + np.uint64(0x632BE59BD9B4E019))

    def part(z, shift):
        return ((z >> np.uint64(shift)) & _BITS).astype(np.float32) * np.float32(2**-25) + np.float32(2**-26)

    least = np.float32(1e-7)
    r = np.maximum(-np.log(part(x, 0) * part(x, 25)), least)
    c = np.log(np.maximum(-np.log(part(y, 0) * part(y, 25)), least))
    b = ((x >> np.uint64(50)).astype(np.float32) + (y >> np.uint64(50)).astype(np.float32) * np.float32(2**-14)) * np.float32(2**-14)
    t = np.floor(weights / r + b)
    return c - r * (t - b) - r


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each text: zeros if it has no words, never zero otherwise."""
    out = np.zeros((len(texts), samples), np.uint16)
    for first, offsets, data in chunks(texts, BLOCK):
        _, _, at, hashes = word_hashes(offsets, data, lower=True)
        if not len(hashes):
            continue
        terms, term = np.unique(hashes, return_inverse=True)
        text = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
        pairs, weight = np.unique(text * len(terms) + term, return_counts=True)
        text, term = np.divmod(pairs, len(terms))
        kinds, kind = np.unique(term * (int(weight.max()) + 1) + weight, return_inverse=True)
        term, weight = np.divmod(kinds, int(weight.max()) + 1)
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        rows = first + text[heads]
        hashes, logs = terms[term], np.log(weight).astype(np.float32)
        for k in range(samples):
            low = np.minimum.reduceat(_log_a(hashes, logs, _SEEDS[k])[kind], heads)
            out[rows, k] = np.maximum(mix(low.view(np.uint32).astype(np.uint64)) & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples of each row: an estimate of the texts' generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def _cuts(ids: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the documents into about equal runs; at most buckets - 1 of them."""
    shares = [k / buckets for k in range(1, buckets)]
    found = ids.agg(F.percentile_approx("id", shares, 100 * buckets)).first()[0] if shares else None
    return sorted({*(found or [])})


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next text, by
    descending id; after the last comes the first. Null texts are empty. Rows without an id come last, and rows of one id
    in the order of their packed texts. Texts without words are alike each other (1.0) and nothing else. Other columns are
    ignored. An empty table gives an empty table. Documents are dealt to runs of ids; the first of each run is also sent
    to the run that needs it as the next, so nothing is sorted in one task. The driver gets one id for each run.
    """
    spark = docs.sparkSession
    buckets = max(16, 2 * shuffle_parts(spark))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts = _cuts(docs.select("id"), buckets)

    def highest(batches):
        for b in batches:
            ids = np.sort(b.column(0).to_numpy())
            run = np.searchsorted(cuts, ids)
            last = np.flatnonzero(np.diff(run, append=-1))
            yield pa.RecordBatch.from_arrays([pa.array(run[last].astype(np.int32)), pa.array(ids[last])], ["run", "id"])

    tops = dict(sorted(docs.select("id").mapInArrow(highest, "run int, id long").groupBy("run").agg(F.max("id")).collect()))
    runs = [*tops]
    wanted = {tops[run]: runs[(k + 1) % len(runs)] for k, run in enumerate(runs)}  # the run that needs this id as its next

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z = pack.compress((text or "").encode())
                rows.append((bisect_left(cuts, i), 0, i, z))
                if i in wanted:
                    rows.append((wanted[i], 1, i, z))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))] if rows else [pa.array([], k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.binary())], ["run", "ghost", "id", "z"])

    def sign(batches):
        def of(block):
            texts = [t for _, t in block]
            own = signatures(pa.array(texts, pa.large_string()), samples)
            halves = [len(t) // 2 for t in texts[:-1]]
            edited = [t[: len(t) - h] + after[:h] for t, after, h in zip(texts, texts[1:], halves)]
            new = signatures(pa.array(edited, pa.large_string()), samples)
            ids = [None if i == _FIRST else i for i, _ in block[:-1]]
            columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([sha256(t.encode()).hexdigest() for t in edited])]
            columns += [pa.array([x.astype(">u2").tobytes().hex() for x in s]) for s in (own[:-1], new)]
            columns += [pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:]))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        unpack = zstandard.ZstdDecompressor()
        at, ended, block, size = None, False, [], 0
        for b in batches:
            for run, ghost, i, z in zip(*(c.to_pylist() for c in b.columns)):
                if run != at:
                    at, ended, block, size = run, False, [], 0
                if ended:
                    continue
                text = unpack.decompress(z).decode()
                block.append((i, text))
                size += len(text)
                ended = bool(ghost)
                if len(block) > 1 and (ended or size >= BLOCK):
                    yield of(block)
                    block, size = block[-1:], len(text)

    dealt = docs.mapInArrow(deal, "run int, ghost int, id long, z binary").repartition(buckets, "run").sortWithinPartitions("run", "ghost", F.desc("id"), "z")
    return dealt.mapInArrow(sign, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text. Nulls and repeats as fingerprints() says."""
    return fingerprints(table(spark, sf_dir, "documents"))

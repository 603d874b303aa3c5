"""Hierarchical multi-length packing of tokenised documents.

A document's full windows are sequences of their own. What is left of it is routed to the smallest context tier that holds
it. Each tier is packed: its longest piece opens a sequence of the tier's length, and the gap is filled from shorter tiers,
with the largest piece that fits or else a part cut from the shortest. So every sequence is full but the last of a task.
Sequences of one tier are dealt to step groups of equal tokens. Tasks work alone on what they read: nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right, insort
from functools import cached_property, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TIERS = (128, 256, 512, 1024)
#: Pieces that wait for a place in a task, and tokens in a step group.
HOLD, STEP = 4096, 8192
#: Chunks whose ids a worker keeps; beyond that the table starts anew.
KEPT = 200_000
_PLAIN = re.compile(r"[\n\r\t -~\u00a1-\u024f]*")
_SPACES = re.compile(r" \s")


class ByteBpe:
    """Ids as the tokenizers library gives them, from tables of tokenised chunks.

    A new pre-token begins before each space that a character other than white space follows, so chunks cut there are
    tokenised alone. Chunks of plain characters go to tiktoken with the same vocabulary, any others to tokenizers.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.chunks: dict[str, bytes] = {}

    @cached_property
    def full(self):
        """The library's own tokenizer, read when a text first needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.json_path)
        found.no_padding()
        found.no_truncation()
        return found

    def chunk(self, chunk: str) -> bytes:
        ids = self.plain.encode_ordinary(chunk) if _PLAIN.fullmatch(chunk) else self.full.encode(chunk, add_special_tokens=False).ids
        found = np.array(ids, "<u4").tobytes()
        if len(chunk) <= 32:
            if len(self.chunks) >= KEPT:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if _SPACES.search(text) or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        known = self.chunks
        if not rest or rest[-1]:
            found = [self.chunk(first)] if first else []
            return b"".join(found + [known.get(c := " " + x) or self.chunk(c) for x in rest])
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(1)
def tokenizer(json_path: str, ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(json_path, ranks_path, pattern)


def default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def sequences(documents, tiers=TIERS, hold: int = HOLD):
    """Yields (tier, pieces) from (document, ids as bytes) pairs; a piece is (document, ids before it, ids as bytes)."""
    window = tiers[-1]
    pool: list[tuple] = []  # (tokens, order, document, start, ids), by tokens
    tokens = order = 0

    def put(document, start, ids):
        nonlocal tokens, order
        order += 1
        tokens += len(ids) // 4
        insort(pool, (len(ids) // 4, order, document, start, ids))

    def drain(least: int):
        nonlocal tokens
        while tokens >= least and pool:
            n, _, document, start, ids = pool.pop()
            tier = next(t for t in tiers if t >= n)
            pieces, gap = [(document, start, ids)], tier - n
            tokens -= n
            while gap and pool:
                k = bisect_right(pool, (gap + 1,)) - 1
                n, _, document, start, ids = pool.pop(max(k, 0))
                tokens -= n
                if n > gap:
                    put(document, start + gap, ids[4 * gap :])
                    n, ids = gap, ids[: 4 * gap]
                pieces.append((document, start, ids))
                gap -= n
            yield tier, pieces

    for document, ids in documents:
        n = len(ids) // 4
        for start in range(0, n - n % window, window):
            yield window, [(document, start, ids[4 * start : 4 * (start + window)])]
        if n % window:
            put(document, n - n % window, ids[4 * (n - n % window) :])
        if len(pool) >= hold:
            yield from drain(window)
    yield from drain(1)


def packed(docs: DataFrame, paths: tuple[str, str, str], tiers=TIERS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (with_ids: ids).

    Each document is its whole text's ids and end_id; null and empty texts are end_id alone. A document longer than the
    largest tier is cut; shorter ones are cut only where a gap needs it. A sequence has tier tokens but for the last of a
    task. Rows are not told apart by their ids (null, repeated). Other columns are ignored. An empty table gives none.
    sequence_id and step_group hold the task's number, so docs should come straight from files: then a task that runs
    again after a loss reads and gives the same.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches):
        from pyspark import TaskContext

        base, bpe = TaskContext.get().partitionId() << 33, tokenizer(*paths)

        def documents():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = (bpe.encode(text) if text else b"") + end
                    yield (doc_id, len(ids) // 4), ids

        rows, steps, count, groups = [], {}, 0, 0
        for tier, pieces in sequences(documents(), tiers):
            group, room = steps.get(tier, (0, 0))
            if room < tier:
                group, room, groups = groups, STEP, groups + 1
            steps[tier] = group, room - tier
            offset = 0
            for (doc_id, n), start, ids in pieces:
                rows.append((doc_id, start, len(ids) // 4, crc32(ids), n, base + count, offset, tier, base + group, *([np.frombuffer(ids, "<u4").astype(np.int32)] if with_ids else [])))
                offset += len(ids) // 4
            count += 1
            if len(rows) >= 10_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids

    def batch(rows):
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    schema = ", ".join(f"{n} {'int' if n == 'tier' else 'array<int>' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens. Nulls and repeats as packed() says."""
    return packed(table(spark, sf_dir, "documents"), default_tokenizer())

"""BPE encoding and decoding with a public vocabulary of word-end BPE; tokenizers are read, never trained.

Encoding keeps a priority queue of merge ranks over a doubly linked list of symbols: the pair of lowest rank, leftmost
first, is merged, its new neighbours enter the queue, and entries whose pair has changed meanwhile are skipped as stale.
Decoding concatenates vocabulary strings (with one space between, as the vocabulary's file names no decoder).
Words recur, so each Python worker keeps the results of short ones in a table of bounded size.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Short words and chunks whose results a worker keeps; beyond that the table starts anew.
KEPT = 400_000
#: White space as the vocabulary's normaliser sees it; Python's split() also takes U+001C to U+001F.
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 upwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBpe:
    """A word-end BPE vocabulary: NFC, white space dropped, lower case, words cut by the file's pattern, bytes as symbols."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        self.strings = [""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for s, i in [*vocab.items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]:
            self.strings[i] = s
        self.ranks, self.merged = {}, []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merges a word's symbols (as ids) until no pair has a rank."""
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [r * n + k for k in range(n - 1) if (r := ranks.get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k = divmod(heapq.heappop(queue), n)
            j = after[k]
            if j < 0 or ids[k] < 0 or ranks.get(ids[k] << 20 | ids[j]) != rank:
                continue  # stale
            ids[k], ids[j] = self.merged[rank], -1
            after[k] = j = after[j]
            if j >= 0:
                before[j] = k
                if (r := ranks.get(ids[k] << 20 | ids[j])) is not None:
                    heapq.heappush(queue, r * n + k)
            if (j := before[k]) >= 0 and (r := ranks.get(ids[j] << 20 | ids[k])) is not None:
                heapq.heappush(queue, r * n + j)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            b = word.encode()
            found = self.merge([*map(self.inner.__getitem__, b[:-1]), self.last[b[-1]]])
            if len(word) <= 32:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids as bytes, and their strings, of a run of characters without white space."""
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        ids = [i for w in self.pattern.findall(text) for i in self.word(w)]
        found = np.array(ids, "<u4").tobytes(), " ".join(map(self.strings.__getitem__, ids))
        if len(chunk) <= 32:
            if len(self.chunks) >= KEPT:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """A text's ids as little-endian unsigned 32-bit integers, and what they decode to."""
        known, ids, strings = self.chunks, [], []
        for part in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if part in self.special:
                ids.append(np.uint32(self.special[part]).tobytes())
                strings.append(part)
                continue
            chunks = part.split() if not _ODD.search(part) else [x for x in _SPACE.split(part) if x]
            found = [known.get(c) or self.chunk(c) for c in chunks]
            ids += [x[0] for x in found]
            strings += [x[1] for x in found if x[1]]
        return b"".join(ids), " ".join(strings)

    def decode(self, ids) -> str:
        return " ".join(self.strings[i] for i in ids)


@lru_cache(1)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, with_ids also (ids, decoded).

    Ids are those of the vocabulary file at path (a parameter; executors read it), special tokens in a text included as such.
    Null and empty texts have no ids. Ids of rows are not looked at (null, repeated); other columns are ignored. An empty
    table gives an empty table. Texts are encoded whole.
    """

    def encode(batches):
        bpe = vocabulary(path)
        for b in batches:
            found = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([len(i) // 4 for i, _ in found], pa.int64()), pa.array([sha256(i).hexdigest() for i, _ in found]), pa.array([sha256(s.encode()).hexdigest() for _, s in found])]
            if with_ids:
                columns += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document. Null and empty texts have no ids; repeats are encoded each."""
    return encoded(table(spark, sf_dir, "documents"), default_vocabulary())

"""MinHash near-dedup by an LSH forest: sorted signature orders, neighbours with a long common prefix, depth by region.

1. Each text becomes its set of distinct shingles (64-bit hashes) and a signature of 128 minhashes. Texts with equal sets are
   one node. A tree's order of signatures starts at the tree's own place in them and goes round.
2. Spark deals the entries of all trees by their first few minhashes and sorts them by what follows. A task reads the sorted
   entries as a stream: those that share the first minhashes are a region. Sorted neighbours, which have the longest common
   prefixes, are compared first, then what they left apart; entries that agree in enough of the next minhashes are
   candidates, and only the groups that candidates form are emitted, a row for each entry.
3. The depth adapts: a region of more than DENSE entries is cut at two more minhashes, in SUBTREES different ways, so that
   a pair at the threshold still meets in one of them; what is dense at the last depth is one group.
4. Candidates that meet, directly or through others, form search groups. Links are confirmed on full sets within them, in
   blocks where a group is large, and Spark finds the components of links.

The depth and the needed agreement follow from the similarity: a pair at the threshold is missed by all trees with a
probability of 1e-6 at most (5e-8 at 0.8). Nothing is capped. Shingles count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, mix, removed, shuffle_parts, table, window_hashes, word_hashes, written
from .ngram_jaccard_join import _blocks, _digest, _open, _pairs, _with_hubs, linked, shingle_sets

#: Minhashes of a signature, trees, and minhashes after a tree's prefix that its entries carry.
SAMPLES, TREES, VIEW = 128, 32, 16
#: Entries that a region may hold before its depth grows, ways in which it is then cut, and how often.
DENSE, SUBTREES, LEVELS = 4096, 16, 3
#: Neighbours on each side that are compared at once; entries of a region beyond them row by row.
NEAR = 31
#: Entries that a task gathers before it looks for regions among them.
GATHER = 1 << 16
_FACTORS = np.random.default_rng(20240311).integers(1 << 32, 1 << 63, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_CANDIDATES = "node long, bucket long, df long, dense boolean"


def shape(num: int, den: int) -> tuple[int, int]:
    """(minhashes of a tree's prefix, needed agreement of those that follow) for a similarity of num / den."""
    s = num / den
    depth = max([d for d in range(1, SAMPLES // TREES + 1) if (1 - s**d) ** TREES <= 1e-6], default=1)
    missed = lambda need: sum(comb(VIEW, k) * s**k * (1 - s) ** (VIEW - k) for k in range(need))
    return depth, max([need for need in range(VIEW + 1) if missed(need) <= 0.002])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each of SAMPLES minhashes, a row for each set; no set is empty."""
    flat, out = np.concatenate(sets), np.empty((len(sets), SAMPLES), np.uint16)
    heads = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = mix(np.minimum.reduceat(flat * factor, heads)) >> np.uint64(48)
    return out


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig) of docs (doc_id, text); sig where a task meets the set first and there is an id."""

    def sign(batches):
        met = set()
        for b in batches:
            n, d1, d2 = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            sigs, known = [None] * b.num_rows, b.column(0).is_valid().to_pylist()
            for first, offsets, data in chunks(b.column(1)):
                _, _, at, hashes = word_hashes(offsets, data, lower=True)
                new = {}
                for k in range(len(at) - 1):
                    own = hashes[at[k] : at[k + 1]]
                    s = np.unique(window_hashes(own, min(width, len(own)))) if len(own) else own
                    row = first + k
                    n[row] = len(s)
                    d1[row], d2[row] = _digest(s)
                    if len(s) and known[row] and d1[row] not in met:
                        met.add(d1[row])
                        new[row] = s
                if new:
                    for row, sig in zip(new, signatures([*new.values()])):
                        sigs[row] = sig.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n, d1, d2)), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _views(sigs: np.ndarray, at: int) -> list[pa.Array]:
    """Two numbers that sort and hold the low bytes of VIEW minhashes from place at on, round the end."""
    taken = (sigs[:, (at + np.arange(VIEW)) % SAMPLES] & np.uint16(0xFF)).astype(np.uint8)
    return [pa.array(np.ascontiguousarray(taken[:, k : k + 8]).view(">i8").ravel().astype(np.int64)) for k in (0, 8)]


def _entries(rows: DataFrame, depth: int, level: int) -> DataFrame:
    """(key, v1, v2, node): the entries of all trees of (node, sig), or of the ways to cut the regions of (key, node, sig)."""

    def plant(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, SAMPLES)
            for t in range(SUBTREES if level else TREES):
                at = SAMPLES // SUBTREES * t + 2 * level if level else SAMPLES // TREES * t
                took = 2 if level else depth
                key = b.column("key").to_numpy().view(np.uint64) if level else np.full(len(sigs), 7, np.uint64)
                key = mix(key + np.uint64(t + 1))
                for k in range(took):
                    key = mix(key ^ sigs[:, (at + k) % SAMPLES].astype(np.uint64) + np.uint64(k << 20))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *_views(sigs, at + took), b.column("node")], ["key", "v1", "v2", "node"])

    return rows.mapInArrow(plant, "key long, v1 long, v2 long, node long")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n entries the first one of those it is connected with by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (label != label[label]).any():
        label = label[label]
    return label


def grouped(key: np.ndarray, view: np.ndarray, need: int) -> np.ndarray:
    """For each entry of sorted regions the first entry of its region that agreeing entries connect it with."""
    n = len(key)
    a, b = [], []
    for k in range(1, NEAR + 1):
        at = np.flatnonzero(key[k:] == key[:-k]) if k < n else []
        if not len(at):
            break
        at = at[(view[at] == view[at + k]).sum(axis=1) >= need]
        a.append(at)
        b.append(at + k)
    label = _labels(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)
    cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1 if n else 0, append=key[-1:] + 1 if n else 0))
    for start, end in zip(cuts[:-1], cuts[1:]):
        if end - start <= NEAR + 1:
            continue
        own, seen = label[start:end], view[start:end]
        for i in range(end - start):
            others = np.flatnonzero(own[i + 1 :] != own[i]) + i + 1
            if not len(others) and (own == own[i]).all():
                break
            meets = others[(seen[others] == seen[i]).sum(axis=1) >= need]
            if len(meets):
                joined = np.unique(np.append(own[meets], own[i]))
                own[np.isin(own, joined)] = joined[0]
    return label


def _met(entries: DataFrame, need: int, level: int) -> DataFrame:
    """(node, bucket, df, dense): the groups that entries form; and, if dense, the entries (node, key) of too large regions."""
    last = level == LEVELS - 1

    def rows(node, bucket, df, dense):
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(bucket), pa.array(df.astype(np.int64)), pa.array(np.full(len(node), dense))], ["node", "bucket", "df", "dense"])

    def found(key, view, node):
        label = grouped(key, view, need)
        size = np.bincount(label, minlength=len(label))[label]
        many = size > 1
        heads = label[many]
        bucket = mix(key[heads].view(np.uint64) ^ mix(node[heads].view(np.uint64)))
        return rows(node[many], bucket.view(np.int64), size[many], False)

    def walk(batches):
        held, dense = [np.zeros(0, np.int64), np.zeros((0, VIEW), np.uint8), np.zeros(0, np.int64)], None
        waiting, count = [held], 0
        for b in chain(batches, (None,)):
            if b is not None:
                key, v1, v2, node = (c.to_numpy() for c in b.columns)
                view = np.stack([v1, v2], axis=1).astype(">i8").view(np.uint8).reshape(-1, VIEW)
                waiting.append([key, view, node])
                count += len(key)
                if count < GATHER:
                    continue
            key, view, node = (np.concatenate(x) for x in zip(*waiting))
            new = np.ones(len(key), bool)  # one entry for each set, which several tasks may have sent
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, view, node = key[new], view[new], node[new]
            if b is None:
                cut = len(key)
            else:
                cut = int(np.searchsorted(key, key[-1]))  # the last region may go on
            starts = np.flatnonzero(np.diff(key[:cut], prepend=key[:1] - 1 if len(key) else 0))
            sizes = np.diff(np.append(starts, cut))
            large = np.repeat((sizes > DENSE) | (key[starts] == dense if dense is not None else False), sizes)
            small = np.flatnonzero(~large & np.repeat(sizes > 1, sizes))
            if len(small):
                yield found(key[small], view[small], node[small])
            at = np.flatnonzero(large)
            tail = slice(cut, len(key))
            if len(key) - cut > DENSE or (len(key) > cut and key[-1] == dense):  # a region beyond what is held
                dense = key[-1]
                at, tail = np.append(at, np.arange(cut, len(key))), slice(len(key) - 1, len(key))
            if len(at):
                yield rows(node[at], mix(key[at].view(np.uint64)).view(np.int64) if last else key[at], np.full(len(at), DENSE), not last)
            waiting, count = [[key[tail], view[tail], node[tail]]], 0

    spread = entries.repartition(max(32, 2 * shuffle_parts(entries.sparkSession)), "key").sortWithinPartitions("key", "v1", "v2", "node")
    return spread.mapInArrow(walk, _CANDIDATES)


def candidates(signed: DataFrame, num: int, den: int) -> DataFrame:
    """(node, bucket, df): sets that meet in a region of the forest and agree there, one row for each and region."""
    depth, need = shape(num, den)
    sigs = signed.filter("sig is not null").select(F.col("d1").alias("node"), "sig")
    rows, out = sigs, None
    for level in range(LEVELS):
        met = written(_met(_entries(rows, depth, level), need, level), "forest-met")
        here = met.filter("not dense").select("node", "bucket", "df")
        out = here if out is None else out.unionByName(here)
        dense = met.filter("dense").select("node", F.col("bucket").alias("key")).distinct()
        if not met.filter("dense").limit(1).count():
            break
        rows = dense.join(sigs.dropDuplicates(["node"]), "node")
    return out


def _confirmed(dealt: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, bucket): ids of sets, and the smallest id of the component that links on full sets join them in, for each block or pair of blocks.

    A block costs time and few bytes, so blocks are dealt to a given number of tasks, which Spark does not join by size.
    """

    def search(t: pa.Table) -> pa.Table:
        reps = t.column("rep").to_numpy()
        first = linked([s.copy() for _, s in shingle_sets(t.column("text"), width)], num, den)
        low = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(low, first, reps)
        many = (np.bincount(first, minlength=len(reps)) > 1)[first]
        return pa.table({"node": reps[many], "bucket": low[first][many]})

    blocks = dealt.join(texts, "rep").select("label", "i", "j", "rep", "text")
    blocks = blocks.repartition(max(32, shuffle_parts(dealt.sparkSession)), "label", "i", "j")
    return blocks.groupBy("label", "i", "j").applyInArrow(search, "node long, bucket long")


def forest_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; two texts link when den * |common| >= num * |union| of their shingles.

    component_id is the smallest id reachable by links, kept whether it is the row's own. A null or empty text, or one
    without words, has no shingles and is its own component. Rows with equal texts are linked (when they have words). A row
    without an id keeps its count, has no component and is kept. An id on several rows is one node. Other columns are
    ignored. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(_signed(docs, width), "forest-sets")
    known = signed.filter("doc_id is not null and n_shingles > 0")
    nodes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
    meets = written(candidates(signed, num, den).repartition("node"), "forest-meets")
    reps = nodes.select(F.col("d1").alias("node"), "rep", "size")
    members = written(_blocks(components(meets.select("node", "bucket"), "forest-groups"), reps), "forest-members")
    texts = written(docs.join(members.select("rep").distinct().hint("merge"), docs.doc_id == F.col("rep")).select("rep", "text"), "forest-texts")
    found = _confirmed(_with_hubs(members, meets), texts, width, num, den)
    if members.filter("blocks > 1").limit(1).count():
        found = written(found, "forest-found")
        open_ = components(_open(meets, members, components(found, "forest-links")), "forest-groups")
        found = found.unionByName(_confirmed(_pairs(_blocks(open_, reps)), texts, width, num, den))
    roots = components(found, "forest-links").withColumnRenamed("label", "root")
    for done in (meets, members, texts):
        removed(done)
    nodes = nodes.join(roots, nodes.rep == roots.node, "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("root", "rep").alias("component_id"))
    joined = signed.join(nodes, (signed.d1 == nodes.e1) & (signed.d2 == nodes.e2) & (signed.n_shingles > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op11_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Sets of four-word shingles, linked at 80 in 100, of all documents. Nulls, empty and repeated rows as forest_components() says."""
    return forest_components(table(spark, sf_dir, "documents"), width=4, num=80, den=100)


#: The same in DuckDB, with shingles as text.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+3], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 2, 2))) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, w.doc_id) AS component_id, coalesce(c.low, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists that Spark partitions.

1. Each text becomes its set of distinct shingles (64-bit hashes). Texts with equal sets are one node from here on.
2. A linked pair shares T = ceil(t * n) shingles at least, so of the n - T + k smallest hashes of each set it shares k.
   These prefixes are dealt by hash to inverted lists; a set with too few shared hashes in its prefix links with nothing.
3. As in DivideSkip, a set sets aside its need - 1 longest lists: a partner must still be on one of the rest. Sets that meet
   on those lists, directly or through others, form a search group; no link leaves its group.
4. Within a group short lists are merged with a heap, long ones are probed by binary search, and pairs with the required
   overlap link. A candidate that already is in the same component is skipped, so that a group of g near copies costs about
   g checks, and only a spanning forest of links is emitted. A large group is searched in blocks, each together with the
   group's hubs; then what still stands on a list with sets of other components is searched again, in pairs of blocks.
5. Components of these links are found by Spark.

Two shingles count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from hashlib import blake2b
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import chunks, components, mix, ranges_for, table, window_hashes, word_hashes, written

#: Sets in one block of a large search group, shingles in it (about), and sets that all its blocks are searched with first.
BLOCK, SHINGLES, HUBS = 256, 1 << 20, 8
#: Postings that a task gathers before it hands them on.
FLUSH = 1 << 20
#: How many hashes the prefixes of a linked pair share: hundredths of a set's size, and a least number for short texts.
EXTRA, LEAST = 8, 24


def shingle_sets(column: pa.Array, width: int):
    """(row, sorted distinct shingle hashes) of each text; a text of fewer words is one shingle, one without words has none."""
    for first, offsets, data in chunks(column):
        _, _, at, hashes = word_hashes(offsets, data, lower=True)
        for k in range(len(at) - 1):
            own = hashes[at[k] : at[k + 1]]
            yield first + k, np.unique(window_hashes(own, min(width, len(own)))) if len(own) else own


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(int(x) for x in np.frombuffer(blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64))


def _at_least(num: int, den: int, n: int) -> int:
    return -(-num * n // den)


def _met(num: int, den: int, n: int) -> int:
    """How many hashes the prefix of a set of n is to share with a partner's that is no smaller; does not fall with n."""
    return min(_at_least(num, den, n), max(LEAST, n * EXTRA // 100))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def sign(batches):
        for b in batches:
            n, d1, d2 = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for row, s in shingle_sets(b.column(1), width):
                n[row] = len(s)
                d1[row], d2[row] = _digest(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(d1), pa.array(d2)], ["doc_id", "n_shingles", "d1", "d2"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long")


def _postings(docs: DataFrame, width: int, num: int, den: int, ranges: int) -> DataFrame:
    """(d1, h, df, need): the prefix hashes of each set that other sets' prefixes have too."""

    def prefixes(batches):
        def deal(sets):
            owners = np.array([*sets], np.int64)
            lengths = np.array([len(s) for s, _ in sets.values()])
            h = np.concatenate([s for s, _ in sets.values()])
            r = (mix(h) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(r, kind="stable")
            cuts = np.flatnonzero(np.diff(r[order], prepend=-1))
            take = lambda x: [x[p].tobytes() for p in np.split(order, cuts[1:])]
            needs = np.array([n for _, n in sets.values()], np.int32)
            return pa.RecordBatch.from_arrays([pa.array(r[order][cuts]), pa.array(take(h), pa.binary()), pa.array(take(np.repeat(owners, lengths)), pa.binary()), pa.array(take(np.repeat(needs, lengths)), pa.binary())], ["r", "h", "d1", "need"])

        sets, held = {}, 0
        for b in batches:
            for _, s in shingle_sets(b.column(1), width):
                if len(s) and (d := _digest(s)[0]) not in sets:
                    least = _at_least(num, den, len(s))
                    s = s[: len(s) - least + _met(num, den, len(s))]
                    sets[d] = (s.copy(), _met(num, den, least))
                    held += len(s)
                    if held >= FLUSH:
                        yield deal(sets)
                        sets, held = {}, 0
        if sets:
            yield deal(sets)

    def lists(t: pa.Table) -> pa.Table:
        h, d1, need = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("h", np.uint64), ("d1", np.int64), ("need", np.int32)))
        order = np.lexsort((d1, h))
        h, d1, need = h[order], d1[order], need[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d1[1:] != d1[:-1])
        h, d1, need = h[new], d1[new], need[new]
        _, which, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[which]
        keep = df > 1
        return pa.table({"d1": d1[keep], "h": h[keep].view(np.int64), "df": df[keep].astype(np.int64), "need": need[keep]})

    dealt = docs.mapInArrow(prefixes, "r int, h binary, d1 binary, need binary")
    return dealt.groupBy("r").applyInArrow(lists, "d1 long, h long, df long, need int")


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the number of the first set of its component, by DivideSkip; two link when den * common >= num * union."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, shingle, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(-np.bincount(owner, df[shingle], minlength=m), kind="stable")  # sets on many lists first: hubs
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    keys = np.sort(rank[shingle] * m + place[owner])
    starts = np.concatenate(([0], np.cumsum(np.sort(df))))
    lists = keys % m
    mine = np.split(np.sort(place[owner] * len(df) + rank[shingle]) % len(df), np.cumsum(sizes[order])[:-1])
    sizes, root = sizes[order], np.arange(m)
    for x in range(1, m):
        own, n = mine[x], int(sizes[x])
        least = _at_least(num, den, n)
        long = min(least - 1, int(least / (0.01 * np.log2(m) + 1)))
        short, rest = own[: n - long], own[n - long :]
        heap = []
        for r in short[starts[short + 1] - starts[short] > 1]:
            entries = lists[starts[r] : starts[r + 1]]
            entries = entries[: np.searchsorted(entries, x)]
            entries = entries[root[entries] != root[x]]
            if len(entries):
                heap.append(entries.tolist())
        if len(heap) < least - long:
            continue
        for y, run in groupby(heapq.merge(*heap)):
            common = sum(1 for _ in run)
            both = n + int(sizes[y])
            if common < least - long or root[y] == root[x] or den * min(n, int(sizes[y])) < num * max(n, int(sizes[y])):
                continue
            probes = rest * m + y
            at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
            common += int((keys[at] == probes).sum())
            if den * common >= num * (both - common):
                root[root == root[x]] = root[y]
    first = np.full(m, m)
    np.minimum.at(first, root, order)
    return first[root][place]


def _blocks(groups: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, node, label, blocks, block): members of groups of two or more, dealt to blocks."""
    groups = groups.join(reps, "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / SHINGLES)).cast("int")
    sized = groups.groupBy("label").agg(F.count("*").alias("sets"), blocks.alias("blocks")).filter("sets > 1").drop("sets")
    return groups.join(sized, "label").withColumn("block", F.expr("cast(pmod(xxhash64(rep, label), blocks) as int)")).select("rep", "node", "label", "blocks", "block")


def _with_hubs(members: DataFrame, meets: DataFrame) -> DataFrame:
    """(rep, label, i, j): each block with itself, and with its group's hubs, the sets on the most and longest lists."""
    degrees = meets.groupBy("node").agg(F.sum("df").alias("degree"))
    tops = members.filter("blocks > 1").join(degrees, "node").groupBy("label", "blocks", "block").agg(F.max(F.struct("degree", "rep")).alias("top"))
    hubs = tops.groupBy("label", "blocks").agg(F.slice(F.sort_array(F.collect_list("top"), False), 1, HUBS).alias("tops"))
    hubs = hubs.select("label", "blocks", F.explode("tops.rep").alias("rep")).select("rep", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"))
    return members.select("rep", "label", F.col("block").alias("i"), F.lit(0).alias("j")).unionByName(hubs).distinct()


def _open(meets: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, bucket) of the lists of large groups that sets of different components are on; others can add no link."""
    at = members.filter("blocks > 1").select("node", "rep").join(roots.select(F.col("node").alias("rep"), F.col("label").alias("root")), "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    on = meets.select("node", "bucket").join(at, "node")
    mixed = on.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    return on.join(mixed, "bucket").select("node", "bucket")


def _pairs(members: DataFrame) -> DataFrame:
    """(rep, label, i, j): each pair of a group's blocks, or the block of a group that has one only."""
    other = F.explode(F.expr("case when blocks = 1 then array(0) else filter(sequence(0, blocks - 1), x -> x <> block) end"))
    return members.withColumn("other", other).select("rep", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _searched(dealt: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, bucket): ids of sets, and the smallest id of the component that one search finds them in."""

    def search(t: pa.Table) -> pa.Table:
        reps = t.column("rep").to_numpy()
        sets = [s.copy() for _, s in shingle_sets(t.column("text"), width)]
        first = linked(sets, num, den)
        low = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(low, first, reps)
        many = (np.bincount(first, minlength=len(reps)) > 1)[first]
        return pa.table({"node": reps[many], "bucket": low[first][many]})

    return dealt.join(texts, "rep").select("label", "i", "j", "rep", "text").groupBy("label", "i", "j").applyInArrow(search, "node long, bucket long")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; two texts link when den * |common| >= num * |union| of their shingles.

    component_id is the smallest id reachable by links. A null or empty text, or one without words, has no shingles and is
    its own component. Rows with equal texts are linked (when they have words). A row without an id keeps its count and
    has no component. An id on several rows is one node. Other columns are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(_signed(docs, width), "jaccard-sets")
    known = signed.filter("doc_id is not null and n_shingles > 0")
    nodes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
    shingles = known.agg(F.sum("n_shingles")).first()[0] or 0
    lists = _postings(docs.filter("doc_id is not null"), width, num, den, ranges_for(spark, shingles * (den - num + EXTRA) // den))
    rarest = Window.partitionBy("d1").orderBy("df", "h")
    ranked = lists.withColumns({"k": F.row_number().over(rarest), "n": F.count("*").over(Window.partitionBy("d1"))})
    meets = written(ranked.filter("n >= need and k <= n - need + 1").select(F.col("d1").alias("node"), F.col("h").alias("bucket"), "df"), "jaccard-meets")
    reps = nodes.select(F.col("d1").alias("node"), "rep", "size")
    groups = components(meets.join(meets.groupBy("bucket").count().filter("count > 1").select("bucket"), "bucket"), "jaccard-groups")
    members = written(_blocks(groups, reps), "jaccard-members")
    texts = written(docs.join(members.select("rep").distinct().hint("merge"), docs.doc_id == F.col("rep")).select("rep", "text"), "jaccard-texts")
    found = _searched(_with_hubs(members, meets), texts, width, num, den)
    if members.filter("blocks > 1").limit(1).count():
        found = written(found, "jaccard-found")
        open_ = components(_open(meets, members, components(found, "jaccard-links")), "jaccard-groups")
        found = found.unionByName(_searched(_pairs(_blocks(open_, reps)), texts, width, num, den))
    roots = components(found, "jaccard-links").withColumnRenamed("label", "root")
    nodes = nodes.join(roots, nodes.rep == roots.node, "left").select("d1", "d2", F.coalesce("root", "rep").alias("component_id"))
    nodes = nodes.withColumnsRenamed({"d1": "e1", "d2": "e2"})
    joined = signed.join(nodes, (signed.d1 == nodes.e1) & (signed.d2 == nodes.e2) & (signed.n_shingles > 0), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs with the smallest id of their component; rows without an id stay. Columns as in docs."""
    found = jaccard_components(docs, width, num, den)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Sets of four-word shingles, linked at 85 in 100, of all documents. Nulls, empty and repeated rows as jaccard_components() says."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


#: The same in DuckDB, with shingles as text.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+3], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 2, 2))) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

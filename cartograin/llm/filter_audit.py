"""Filter interaction audit: what five text filters remove alone and in every order, from one table-driven pass over bytes.

1. A finite-state transducer reads each UTF-8 byte once. Its table gives, for a state (between words, in a word, one to three
   bytes of a character still to come) and a byte, the next state and marks: a word begins, a word has ended, a character
   begins, a capital, a symbol. numpy steps it over many segments of a buffer at once; a segment starts four bytes early,
   after which the state is the same as from the beginning, for no character is longer.
2. Word spans go into an open-addressing hash table, in rounds; a span counts as a repeat only after its bytes were compared
   with those of the slot's owner, so distinct words are exact.
3. Spark finds texts that a smaller id has (the least id of each 128-bit digest, joined on digest and id, so copies of one
   text spread out), counts the 32 sets of failed filters of each part, and derives all orders from these counts.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _power, chunks, fresh, mix, table, written

FILTERS = "ABCDE"
#: States of the transducer, and the marks of a step.
GAP, WORD, ONE, TWO, THREE = range(5)
BEGINS, ENDED, CHARACTER, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
#: Bytes of a segment, and bytes before it that settle the state.
SEGMENT, SETTLE = 256, 4


def _step(state: int, byte: int, symbols: bytes) -> tuple[int, int]:
    if state >= ONE and 0x80 <= byte < 0xC0:
        return (WORD, ONE, TWO)[state - ONE], 0
    if byte == 0x20 or 0x09 <= byte <= 0x0D:
        return GAP, CHARACTER | (ENDED if state != GAP else 0)
    marks = CHARACTER | (BEGINS if state == GAP else 0) | (CAPITAL if 65 <= byte <= 90 else 0) | (SYMBOL if byte in symbols else 0)
    lead = ONE if 0xC0 <= byte < 0xE0 else TWO if 0xE0 <= byte < 0xF0 else THREE if 0xF0 <= byte < 0xF8 else WORD
    return lead, marks


def transducer(symbols: bytes = b"#$%&*|") -> np.ndarray:
    """The table: at state * 256 + byte, the next state * 256 and the marks. A malformed byte counts as a character of a word."""
    steps = [_step(state, byte, symbols) for state in range(5) for byte in range(256)]
    return np.array([state << 8 | marks for state, marks in steps], np.uint16)


def marked(data: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The marks of each byte, as the transducer gives them from the first byte on in the state between words."""
    n = -(-len(data) // SEGMENT)
    held = np.full(n * SEGMENT + SETTLE, 0x20, np.uint8)
    held[SETTLE : SETTLE + len(data)] = data
    marks, state = np.empty(n * SEGMENT, np.uint8), np.zeros(n, np.uint16)
    for k in range(SEGMENT + SETTLE):
        step = steps[state | held[k : k + (n - 1) * SEGMENT + 1 : SEGMENT]]
        state = step & np.uint16(0xFF00)
        if k >= SETTLE:
            marks[k - SETTLE :: SEGMENT] = step
    return marks[: len(data)]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of equal, positive lengths at a and b hold the same bytes."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    return np.logical_and.reduceat(data[np.repeat(a, lengths) + at] == data[np.repeat(b, lengths) + at], ends - lengths)


def first_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each span whether it is the one that its owner's equal spans are counted by: one of each is. By a verified hash table."""
    power, inverse = _power(len(data) + 1)
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=summed[1:])
    hashes = mix((summed[ends] - summed[starts]) * inverse[starts] + mix(owner.astype(np.uint64)))
    mask = (1 << (2 * len(starts) + 1).bit_length()) - 1
    slots, place = np.full(mask + 1, -1, np.int64), (hashes & np.uint64(mask)).astype(np.int64)
    first, open_ = np.zeros(len(starts), bool), np.arange(len(starts))
    while len(open_):
        free = slots[place[open_]] < 0
        slots[place[open_[free]]] = open_[free]
        holder = slots[place[open_]]
        first[open_[holder == open_]] = True
        others, holder = open_[holder != open_], holder[holder != open_]
        alike = (hashes[others] == hashes[holder]) & (owner[others] == owner[holder]) & (ends[others] - starts[others] == ends[holder] - starts[holder])
        if alike.any():
            alike[alike] = _same_bytes(data, starts[others[alike]], starts[holder[alike]], (ends - starts)[others[alike]])
        open_ = others[~alike]
        place[open_] = (place[open_] + 1) & mask
    return first


def measures(column: pa.Array, symbols: bytes = b"#$%&*|") -> np.ndarray:
    """(words, distinct words, capitals, characters, symbols) of each text, one row a text; null is empty."""
    out, steps = np.zeros((len(column), 5), np.int64), transducer(symbols)
    for row, offsets, body in chunks(column):
        n = len(offsets) - 1
        data = np.full(len(body) + n, 0x20, np.uint8)  # a space after each text ends its last word
        data[np.arange(len(body)) + np.repeat(np.arange(n), np.diff(offsets))] = body
        heads = offsets[:-1] + np.arange(n)
        marks = marked(data, steps)
        starts, ends = np.flatnonzero(marks & BEGINS), np.flatnonzero(marks & ENDED)
        owner = np.searchsorted(heads, starts, "right") - 1
        own = out[row : row + n]
        own[:, 0] = np.bincount(owner, minlength=n)
        own[:, 1] = np.bincount(owner[first_spans(data, starts, ends, owner)], minlength=n)
        for k, mark in ((2, CAPITAL), (3, CHARACTER), (4, SYMBOL)):
            own[:, k] = np.add.reduceat((marks & mark) != 0, heads, dtype=np.int64)
        own[:, 3] -= 1
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: bytes = b"#$%&*|") -> DataFrame:
    """(doc_id, n_words, n_distinct, n_capitals, n_chars, n_symbols, digest) of each row; a null text is empty. Other columns are ignored."""
    names = ["doc_id", "n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols", "digest"]
    return _measured(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), symbols).select(*names)


def _measured(docs: DataFrame, symbols: bytes) -> DataFrame:
    """docs (doc_id, text and columns of any names) with measures and a digest of the text for the text."""
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            found = measures(texts, symbols)
            digests = [blake2b((t or "").encode(), digest_size=16).digest() for t in texts.to_pylist()]
            columns = [*map(b.column, map(b.schema.get_field_index, names)), *map(pa.array, np.ascontiguousarray(found.T)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols", "digest"])

    return docs.mapInArrow(run, f"{kinds}, n_words long, n_distinct long, n_capitals long, n_chars long, n_symbols long, digest binary")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 100, distinct: int = 80, capitals: int = 10, symbols: bytes = b"#$%&*|") -> DataFrame:
    """(doc_id, part, failed) of each row; failed is a sum of 1 (A) to 16 (E).

    A: under least_words words. B: distinct words under distinct in 100. C: A-Z over capitals in 100 characters. D: any of
    symbols. E: the text of a smaller id; a row without an id has none smaller and is smaller than none, rows of one id take
    nothing from each other. Null texts are empty, null parts empty strings. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    found = _measured(rows, symbols)
    tests = [F.col("n_words") < least_words, 100 * F.col("n_distinct") < distinct * F.col("n_words"), 100 * F.col("n_capitals") > capitals * F.col("n_chars"), F.col("n_symbols") > 0]
    failed = sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))
    found = written(found.select("doc_id", "part", "digest", failed.alias("failed")), "audit-rows")
    known = found.filter("doc_id is not null")
    least = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    known = known.join(least, ["digest", "doc_id"], "left").withColumn("failed", F.col("failed") + F.when(F.col("least"), 0).otherwise(16))
    return known.select("doc_id", "part", "failed").unionByName(found.filter("doc_id is null").select("doc_id", "part", "failed"))


def audited(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the five filters and step, what the step's filter does; failed is the table of failures().

    labels (doc_id, quality, toxic): a document is good when a row of its id has quality 1, toxic when one has toxic 1; rows
    without an id and ids of no document count nothing. Counts, all long: kept after the step; removed by it; redundant
    (fails its filter, removed before); unique_fails (fails no other); good_lost and toxic_lost (of those removed); shapley
    (removed by the filter, over all 120 orders). An empty table gives no part and no row.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    count = lambda column: F.sum(F.coalesce(column, F.lit(0))).cast("long")
    known, rest = failed.filter("doc_id is not null").join(marks, "doc_id", "left"), failed.filter("doc_id is null")
    known = known.unionByName(rest.withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    sets = known.groupBy("part", "failed").agg(F.count("*").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    steps = steps.withColumn("own", F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)"))
    steps = steps.withColumn("before", F.expr("aggregate(sequence(1, 5), 0, (a, k) -> a + if(k < step, shiftleft(1, ascii(substr(filter_order, k, 1)) - 65), 0))"))
    fails, earlier = (F.col("failed").bitwiseAND(F.col(c)) != 0 for c in ("own", "before"))
    total = lambda test, n, name: F.sum(F.when(test, F.col(n)).otherwise(0)).cast("long").alias(name)
    share = F.when(fails, F.col("n") * F.expr("120 div bit_count(failed)")).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, "n", "kept"), total(fails & ~earlier, "n", "removed"), total(fails & earlier, "n", "redundant"), total(F.col("failed") == F.col("own"), "n", "unique_fails"),
        total(fails & ~earlier, "good", "good_lost"), total(fails & ~earlier, "toxic", "toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )


def surviving(docs: DataFrame, filters: str = FILTERS, **limits) -> DataFrame:
    """The rows of docs that fail none of the filters named; rows without an id are judged by their own row. Columns as in docs."""
    key = fresh(docs.columns, name="row_")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "audit-docs")
    bits = sum(1 << FILTERS.index(f) for f in filters)
    id_col, text_col, part_col = (limits.pop(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("part_col", "lang")))
    known = rows.filter(F.col(id_col).isNotNull())
    judged = failures(known, id_col, text_col, part_col, **limits).filter(F.col("failed").bitwiseAND(bits) == 0).select(F.col("doc_id").alias("_kept")).distinct()
    kept = known.join(judged, known[id_col] == judged["_kept"], "left_semi")
    loose = rows.filter(F.col(id_col).isNull())
    judged = failures(loose.withColumn("_row", F.col(key)), "_row", text_col, part_col, **limits).filter(F.col("failed").bitwiseAND(bits & 15) == 0).select(F.col("doc_id").alias("_kept"))
    return kept.unionByName(loose.join(judged, loose[key] == judged["_kept"], "left_semi")).drop(key)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents and labels. Nulls, repeats and empty tables as failures() and audited() say."""
    return audited(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


#: The same in DuckDB.
SQL = r"""
WITH f AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY t) AS low FROM f),
m AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * capitals > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS failed FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS (SELECT filter_order, step::INT AS step, (1 << (ascii(substr(filter_order, step, 1)) - 65))::INT AS own, coalesce(list_sum([(1 << (ascii(substr(filter_order, k, 1)) - 65)) for k in range(1, step)]), 0)::INT AS before FROM o, range(1, 6) AS t(step))
SELECT part, filter_order, step,
sum(CASE WHEN failed & own = 0 AND failed & before = 0 THEN n ELSE 0 END)::BIGINT AS kept,
sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
sum(CASE WHEN failed & own <> 0 AND failed & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
sum(CASE WHEN failed & own <> 0 THEN n * (120 // bit_count(failed)) ELSE 0 END)::BIGINT AS shapley
FROM g, s GROUP BY part, filter_order, step
"""

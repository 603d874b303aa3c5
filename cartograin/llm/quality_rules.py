"""Quality rules with DataFrame functions only: counts of each text, and how often its lines stand in other documents.

Cross-document line frequency: lines are normalised (lower case, digit runs as 0, outer white space off) and hashed; for
each host the distinct texts that hold a line are counted; lines above the host's limit are removed; a document that keeps
too few of its words is depleted and rejected. The limit grows with the root of the host's texts, so that boilerplate of a
part of a large host is found too. Copies of a text count once, so a copied document is not boilerplate. Texts are read
once: counts and hashes of lines go to a table from which everything else is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALT, fresh, table, written

_WHITE = " \t\n\u000b\f\r"
_GAP = r"[\x20\x09-\x0D]+"


def _letters(text: Column) -> Column:
    return F.translate(text, _WHITE, "")


def _covered(order: str) -> Column:
    """Words in windows of three that are found twice or more; order: a column of (hash, place) sorted by hash, then place."""
    same = F.expr(f"filter({order}, (x, k) -> x.h = get({order}, k - 1).h or x.h = get({order}, k + 1).h)")
    return F.array_sort(F.transform(same, lambda x: x["i"]))


def _counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, host, text) as a hash of the text, its counts and its lines with a word (normalised hash h and words n of each)."""
    text = F.col("text")
    line = F.expr("filter(split(text, '\\n', -1), x -> translate(x, ' \\t\\n\\u000b\\f\\r', '') <> '')")
    rows = docs.select("doc_id", "host", "text", F.filter(F.split(text, _GAP, -1), lambda w: w != "").alias("words"), line.alias("lines"))
    rows = rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(_letters(text)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.transform("lines", lambda x: F.trim(x, F.lit(_WHITE))), lambda x: F.struct(_trimmed_hash(x).alias("h"), F.size(F.split(x, _GAP, -1)).cast("long").alias("n"))).alias("lines"),
        F.expr("transform(sequence(0, greatest(size(words) - 3, 0)), i -> named_struct('h', xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), 'i', i))").alias("windows"),
    )
    rows = rows.withColumn("order", F.when(F.size(F.array_distinct("windows.h")) < F.size("windows"), F.array_sort("windows")).otherwise(F.expr("slice(windows, 1, 0)"))).drop("windows")
    rows = rows.withColumn("at", _covered("order")).drop("order")
    covered = F.expr("aggregate(transform(at, (p, k) -> least(3, coalesce(get(at, k + 1) - p, 3))), 0L, (a, x) -> a + x)")
    return rows.withColumn("n_repeat_words", F.when(F.size("at") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("at")


def _trimmed_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.lower(line), "[0-9]+", "0"))


def _line_hash(line: Column) -> Column:
    return _trimmed_hash(F.trim(line, F.lit(_WHITE)))


def _of_common(rows: DataFrame, least: int, per_root: int) -> DataFrame:
    """(doc_id, host, text_hash, h, n) of the lines that are common on their host. rows: those of _counts()."""
    lines = rows.select("doc_id", "host", "text_hash", F.inline("lines"))
    texts = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    found = lines.select("host", "h", "text_hash").distinct().groupBy("host", "h").agg(F.count("*").alias("held")).filter(F.col("held") > least)
    beyond = per_root * per_root * F.col("held") * F.col("held") > F.col("texts")
    common = found.join(texts, "host").filter(beyond).select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.col("text_hash"), F.lit(SALT)).cast("int"))
    return salted.join(common, ["host", "h", "salt"])


def quality(docs: DataFrame, least: int = 5, per_root: int = 2, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_common_words) of each row.

    A line is common on a host if more than least of its distinct texts hold it, and per_root times their number is above
    the root of the host's distinct texts. kept is false if base_failed, or if common lines hold words and fewer than
    min_words or under half of the words are left. Null and empty texts have no words and fail. A null host is a host of
    its own. Ids are not looked at, but rows of one id, host and text have one verdict. Other columns are ignored. An empty
    table gives an empty table.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    host = F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit(""))
    counts = written(_counts(docs.withColumn("host", host)), "quality-counts")
    gone = _of_common(counts, least, per_root).groupBy("doc_id", "host", "text_hash").agg(F.sum("n").alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "id_", "host": "host_", "text_hash": "hash_"})
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("host") == F.col("host_")) & (F.col("text_hash") == F.col("hash_"))
    rows = counts.select("doc_id", "host", "text_hash").groupBy("doc_id", "host", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1")
    gone = gone.join(rows, same, "left").select("id_", "host_", "hash_", F.expr("gone div coalesce(rows, 1)").alias("n_common_words"))
    joined = counts.drop("lines").join(gone, same, "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_common_words")
    depleted = F.coalesce((left < min_words) | (2 * left < F.col("n_words")), F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce("n_common_words", F.lit(0)).alias("n_common_words")
    )


def without_common_lines(docs: DataFrame, least: int = 5, per_root: int = 2, min_words: int = 50, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps, their texts without the lines that are common on their host. Columns as in docs."""
    id_, host, text, hash_, gone = (fresh(docs.columns, name=x) for x in ("_id", "_host", "_text", "_hash", "_gone"))
    marked = docs.withColumn(host, F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))).withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    marked = marked.withColumn(hash_, F.xxhash64(text)).withColumn(id_, F.concat_ws(":", F.sha2(text, 256), host))
    once = marked.select(id_, F.col(host_col), F.col(text_col)).dropDuplicates([id_])
    kept = quality(once, least, per_root, min_words, id_, text_col, host_col).filter("kept").select("doc_id")
    plain = marked.select(F.col(id_).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")).dropDuplicates(["doc_id"])
    common = _of_common(_counts(plain), least, per_root).groupBy(F.col("doc_id").alias("id_")).agg(F.collect_set("h").alias(gone))
    kept = kept.join(common, F.col("doc_id") == F.col("id_"), "left").select(F.col("doc_id").alias("id_"), gone)
    joined = marked.join(kept, marked[id_] == kept["id_"])
    left = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x: (_letters(x) == "") | ~F.array_contains(F.col(gone), _line_hash(x))), "\n")
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)).select(docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents. Nulls, empty and repeated rows as quality() says."""
    return quality(table(spark, sf_dir, "documents"))


#: The same in DuckDB: lines by their text where Spark takes hashes.
SQL = r"""
WITH d AS (SELECT doc_id, '=' || source AS host, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT doc_id, i, words[i:i+2] AS win FROM c, unnest(range(1, len(words) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, regexp_replace(lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[0-9]+', '0', 'g') AS norm,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, host, text, unnest(lines) AS line FROM c)),
h AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
f AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS held FROM l GROUP BY host, norm) JOIN h USING (host) WHERE held > 5 AND 4 * held * held > texts),
g AS (SELECT doc_id, sum(n)::BIGINT AS gone FROM l JOIN f USING (host, norm) GROUP BY doc_id),
a AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, gone
  FROM c LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words - gone < 50 OR 2 * (n_words - gone) < n_words, false) AS kept, coalesce(gone, 0)::BIGINT AS n_common_words FROM b
"""

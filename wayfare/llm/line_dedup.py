"""Line dedup: lines that many documents hold are dropped from all of them.

A line's key is the line without white space at its ends, A-Z lower-cased. Lines
are exploded and hashed, the distinct documents of each hash are counted with a
partial sum before the shuffle, and the lines whose key reaches the threshold
are named by position. What a text loses depends on the text alone, so positions
are gathered once for each distinct text (told by a digest) and joined to the
documents, which put the other lines together again by position.

Everything is a DataFrame function; no Python runs on the executors. Hashes and
digests are two seeded 64-bit hashes, so that one is as good as 128 bits. A line
that a third of all documents hold is one row for each of them in the join with
the frequent keys; both sides of the joins come from a shuffle of their own, so
adaptive execution can split such a key. Nothing is broadcast by hand.

Defined results: a null or empty text is one empty line; a null text stays null
where texts are returned. An empty key is never dropped. Each row is a document,
also where ids are null or repeated, and a line that occurs several times in one
document counts once. A text whose lines all go is empty. An empty table gives
no rows. Further columns of the table pass through, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import settle

#: What counts as white space at the ends of a line.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line as it is compared: trimmed, A-Z in lower case, other letters as they are."""
    cut = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(value: Column, name: str) -> list[Column]:
    return [F.xxhash64(value).alias(f"{name}1"), F.xxhash64(F.lit(1), value).alias(f"{name}2")]


def frequent_keys(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(key1, key2, documents): hashes of the keys of at least min_chars code points that at least min_docs rows hold."""
    own = docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), line_key))).alias("key"))
    own = own.filter(F.char_length("key") >= min_chars).select(*_hashed(F.col("key"), "key"))
    return own.groupBy("key1", "key2").agg(F.count("*").alias("documents")).filter(F.col("documents") >= min_docs)


def _dropped(docs: DataFrame, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """(text1, text2, dropped): for each distinct text that loses lines, their positions from 0."""
    frequent = settle(frequent_keys(docs, text_col, min_docs, min_chars).select("key1", "key2"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(*_hashed(text, "text"), F.posexplode(_lines(text)).alias("at", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    hit = lines.select("text1", "text2", "at", *_hashed(F.col("key"), "key")).join(frequent, ["key1", "key2"], "left_semi")
    return settle(hit.groupBy("text1", "text2").agg(F.collect_set("at").alias("dropped")))


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the frequent lines gone from text_col; all other columns as they were, and the two counts behind them unless counts is None."""
    dropped = _dropped(docs, text_col, min_docs, min_chars)
    text = F.col(text_col)
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    others = [c for c, name in zip(others, docs.columns) if name != text_col]
    # lines are split below the join: above it they are a column, which the lambda can index without splitting anew
    rows = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), text.isNull().alias("none"), _lines(text).alias("lines"), *_hashed(F.coalesce(text, F.lit("")), "text"))
    joined = rows.join(dropped, ["text1", "text2"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    out = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = F.when(~F.col("none"), out)
    columns = [(out if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    if counts:
        columns += [F.size("lines").cast("long").alias(counts[0]), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*columns)


def line_dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: id, n_lines, n_dropped, kept_sha256."""
    out = line_dedup(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", min_docs, min_chars)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows for DuckDB; rows are told apart by number, as ids may repeat.
ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key AS gone FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad ON k.key = bad.gone GROUP BY r, doc_id
"""

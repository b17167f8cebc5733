"""Line dedup against a plain count over all lines."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from wayfare.llm.line_dedup import ORACLE, line_dedup, line_dedup_digest
from wayfare.llm.queries import QUERIES, table

FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def brute(docs, least=10):
    held = {}
    for i, (_, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(held[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_against_brute_force(spark):
    r = random.Random(1)
    common = ["Share this", "  share THIS\t", "ÉTÉ", "été", "\x0bAll rights reserved\r", " wide", "", "   ", "x"]
    docs = [(i, "\n".join(r.choice(common) if r.random() < 0.5 else f"line {r.randrange(60)}" for _ in range(r.randint(1, 12)))) for i in range(150)]
    docs += [(7, "Share this"), (None, "Share this\nonly here"), (None, None), (8, ""), (8, "\n\n"), (9, "one\r\nSHARE THIS\r\ntwo Share this")]
    docs += [(1000 + i, "same text\nof many") for i in range(12)] + [(2000, "same text\nof many\nand more"), (2001, "same text\nsame text")]
    docs.append((3000, "\n".join(f"long {i}\nShare this" for i in range(20_000))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for least in (2, 10):
        assert rows(line_dedup_digest(df, min_docs=least)) == brute(docs, least)


def test_one_document_counts_once(spark):
    docs = [(i, "again\n" * 20 + "again") for i in range(9)]
    assert {x.n_dropped for x in line_dedup_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {0}
    docs.append((9, "AGAIN"))
    got = line_dedup_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(x.n_dropped for x in got) == [1] + [21] * 9 and len({x.kept_sha256 for x in got}) == 1


def test_columns_pass_through(spark):
    names = ["text", "lines", "row", "dropped", "text1", "none", "a b"]
    df = spark.createDataFrame([(f"keep {i}\ncommon" if i else None, i, "r", [i], "t", True, i) for i in range(12)], "text string, lines int, row string, dropped array<int>, text1 string, none boolean, `a b` long")
    got = line_dedup(df, counts=None)
    assert got.columns == names
    assert rows(got) == sorted(((f"keep {i}" if i else None, i, "r", [i], "t", True, i) for i in range(12)), key=repr)
    # with fewer characters than asked for, keys stay
    assert rows(line_dedup(df, min_chars=7, counts=None)) == rows(df)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup_digest(empty).collect() == [] and line_dedup(empty).columns == ["doc_id", "text", "n_lines", "n_dropped"]


def test_query(spark, sf_dir="/root/testdata/sf0.001"):
    """The registered query on the given table, against brute force and the SQL; no Python in its plan."""
    got = QUERIES["op11_line_dedup"](spark, sf_dir)
    docs = [tuple(x) for x in table(spark, sf_dir, "documents").select("doc_id", F.col("text")).collect()]
    assert rows(got) == brute(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    assert sorted(con.execute(ORACLE).fetchall(), key=repr) == rows(got)
    assert "Python" not in got._jdf.queryExecution().toString()

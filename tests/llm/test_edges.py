"""Edge cases that every operator defines: repeated rows, very long texts, extra columns with clashing names, empty tables, many shards."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfare.llm.blocks import _tables
from wayfare.llm.decontaminate import contamination, decontaminate
from wayfare.llm.fingerprints import near_duplicates, neighbours
from wayfare.llm.jaccard_join import jaccard_components, one_of_each_component
from wayfare.llm.repeats import Search, rows_of
from wayfare.llm.substring_dedup import automaton_kernel, substring_dedup, without_repeats
from wayfare.llm.suffix_array import suffix_array_dedup, suffix_ranks
from wayfare.llm.toxicity import toxicity, without_toxic
from wayfare.llm.url_filter import url_filter

#: Names that the operators use inside or return themselves.
CLASHING = ("id", "block", "at", "key", "k", "c0", "comp", "n_words", "n_bytes", "n_chars", "kept_sha256", "score", "fingerprint", "item_id")


def corpus(spark):
    """Texts with copies, repeated rows, a null, an empty and a very long one, and many further columns."""
    r = random.Random(31)
    text = lambda n: " ".join(f"w{r.randrange(2000)}" for _ in range(n))
    long = text(150_000)
    docs = [(i, text(r.randint(1, 60))) for i in range(20)]
    docs += [(20, docs[3][1]), (21, docs[3][1]), (3, docs[3][1]), (5, docs[5][1]), (22, None), (22, None), (23, ""), (24, long), (25, long[: len(long) // 2]), (26, long)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return docs, frame.withColumns({c: F.lit(7) for c in CLASHING})


def test_counts_of_repeated_and_long_rows(spark):
    docs, df = corpus(spark)
    rows = Counter(d for d, _ in docs)
    for operator in (substring_dedup, suffix_array_dedup, jaccard_components, neighbours, near_duplicates):
        got = operator(df).collect()
        assert Counter(x["doc_id"] for x in got) == rows, operator.__name__
    by = {x.doc_id: x for x in suffix_array_dedup(df).collect()}
    size = {d: len((t or "").encode()) for d, t in docs}
    assert by[26].n_removed == size[26] and by[25].n_removed == size[25] and by[24].n_removed == 0 and by[26].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[20].n_removed == (size[20] if size[20] >= 50 else 0) and by[3].n_removed == 0
    comp = {x.doc_id: x.component_id for x in jaccard_components(df).collect()}
    assert comp[26] == comp[24] == 24 and comp[20] == comp[21] == comp[3] == 3 and comp[22] == 22 and comp[23] == 23


def test_toxicity_of_repeated_and_long_rows(spark):
    docs, df = corpus(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity(df, labels).collect()
    assert Counter(x.doc_id for x in got) == Counter(d for d, _ in docs)
    assert len({x.score for x in got if x.doc_id in (3, 20, 21)}) == 1 and all(0 <= x.score <= 1 for x in got)
    assert toxicity(df.limit(0), labels).count() == 0 and toxicity(df, labels.limit(0)).count() == len(docs)


def test_items_in_repeated_and_long_rows(spark):
    docs, df = corpus(spark)
    long = dict(docs)[24].split()
    bench = spark.createDataFrame([(1, " ".join(long[70_000:70_030]), 5), (2, None, 5), (2, "", 5)], "item_id long, text string, id int")
    assert sorted((x.doc_id, x.item_id) for x in contamination(df, bench).collect()) == [(24, 1), (25, 1), (26, 1)]
    assert decontaminate(df, bench).columns == df.columns and decontaminate(df, bench).count() == len(docs) - 3


def test_urls_of_repeated_rows(spark):
    rows = [(1, "http://a.example.net/en/x", 1), (1, "http://a.example.net/en/x", 1), (2, "x" * 300_000, 2), (3, "http://" + "a-" * 50_000 + ".org/fr/" + "y" * 1000, 2), (None, None, 1)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, host int").withColumns({c: F.lit(1) for c in ("path", "score", "features", "entropy", "label")})).collect()
    assert Counter(x.page_id for x in got) == Counter(x[0] for x in rows)
    assert [x.verdict for x in got if x.page_id == 1] == ["allow"] * 2 and [x.rule for x in got if x.page_id == 3] == ["org/fr/"]


@pytest.mark.parametrize("key_shard,context_shard", [(10, 300), (1_000_000, 4_000_000)])
def test_many_shards_give_the_same(spark, key_shard, context_shard):
    """With the number of shards far over its floor, the windows found stay the same."""
    r = random.Random(9)
    text = lambda n: " ".join(f"v{r.randrange(400)}" for _ in range(n))
    shared = [text(25) for _ in range(6)]
    docs = [(i, text(r.randint(0, 40)) + " " + shared[i % 6] + " " + text(r.randint(0, 40))) for i in range(90)]
    search = Search("words", 13, 5, automaton_kernel, key_shard=key_shard, context_shard=context_shard)
    noted = search.start(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), "doc_id", "text")
    import pyarrow as pa

    def run(batches):
        for row in rows_of(batches):
            units, gone = search.covered(row)
            b = units.bounds
            yield pa.RecordBatch.from_pydict({"id": pa.array(units.block.ids, pa.int64()), "n": pa.array([int(np.count_nonzero(gone[x:y])) for x, y in zip(b[:-1], b[1:])], pa.int64())})

    got = dict(tuple(x) for x in noted.mapInArrow(run, "id long, n long").collect())
    assert (search.s1 > 48) == (key_shard == 10) and (search.s2 > 48) == (key_shard == 10)
    first, want = {}, {}
    for d, t in docs:
        u = t.split()
        for i in range(len(u) - 12):
            w = tuple(u[i : i + 13])
            first[w] = min(first.get(w, d), d)
    for d, t in docs:
        u = t.split()
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - 12):
            if first[tuple(u[i : i + 13])] < d:
                gone[i : i + 13] = True
        want[d] = int(gone.sum())
    assert got == want and sum(want.values()) > 1000


def test_difference_cover_over_dataframes(spark):
    """A string whose names repeat for more than one level, so the recursion goes on twice at least."""
    r = random.Random(1)
    s = [r.randint(1, 2) for _ in range(20)] * 2 + [1]
    got = [x.pos for x in suffix_ranks(spark.createDataFrame(list(enumerate(s)), "pos long, v long")).orderBy("rank").collect()]
    assert got == sorted(range(len(s)), key=lambda i: s[i:])


def test_pipeline_on_empty_tables_and_clashing_columns(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/none/documents.parquet")
    for folder in ("none", "some"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs, df = corpus(spark)
    df.write.parquet(f"{tmp_path}/some/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {x.doc_id for x in out} >= {i for i in range(20)} | {22, 23, 24} and not {20, 21, 26} & {x.doc_id for x in out}
    for stage in (without_toxic(df, spark.read.parquet(f"{tmp_path}/some/labels.parquet")), one_of_each_component(df), without_repeats(df)):
        assert stage.dtypes == df.dtypes
    from wayfare.llm.blocks import release

    release(spark)
    assert not _tables.get(spark.sparkContext.applicationId)

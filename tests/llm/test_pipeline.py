"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline
from wayfare.llm.queries import QUERIES


def make(spark, folder):
    r = random.Random(12)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    shared, item = text(60), text(25)
    docs, labels = [], []
    for i in range(200):
        t = text(r.randint(20, 120))
        if i % 10 == 3:
            t += " dreckwort " + text(3)
        if i % 20 == 5:
            t = t + " " + shared
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(i % 10 == 3)))
    docs.append((300, docs[0][1], "en", "s", 1))
    docs.append((301, docs[1][1] + " more", "en", "s", 1))
    docs.append((302, text(30) + " " + item + " " + text(9), "en", "s", 1))
    docs += [(303, None, None, None, None), (304, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = {d[0]: d[1] for d in make(spark, str(tmp_path))}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, state = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/out_{name}")
        frame = spark.read.parquet(f"{tmp_path}/out_{name}")
        assert frame.columns == columns
        state[name] = {x.doc_id: x.text for x in frame.collect()}
    clean = {i: t for i, t in docs.items() if not (i < 200 and i % 10 == 3)}
    assert state["toxicity"] == clean
    assert set(clean) - set(state["near_duplicates"]) >= {300} and 303 in state["near_duplicates"]
    before, after = state["near_duplicates"], state["substrings"]
    holders = [i for i in before if i < 200 and i % 20 == 5]
    assert after[holders[0]] == before[holders[0]]
    for i in holders[1:]:
        assert after[i] == " ".join(before[i].split()[:-60])
    assert all(after[i] == before[i] for i in after if i not in holders and i != 301)
    assert set(after) - set(state["benchmark"]) == {302}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in final} == set(state["benchmark"])


def test_registered():
    assert sorted({int(k[2:].split("_")[0]) for k in QUERIES}) == list(range(1, 11))

"""Packing and sharding: round trips and laws."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayfare.llm.packing import Encoder, best_fit_packing, fill
from wayfare.llm.sharding import balanced_shards


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


TEXTS = ["", "a", "Hello  world", "x \n y", "tab\t z", " lead", "trail ", "é ü ß", "<|endoftext|> no", "a b", "one two three " * 2000, "12 345", "don't  stop", "a\n\n b", "long" * 3000]


def test_encoder_equals_whole_text():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    model.encode_special_tokens = True
    want = [np.array(x.ids, "<u4").tobytes() for x in model.encode_batch(TEXTS, add_special_tokens=False)]
    with open(vocabulary(), encoding="utf-8") as f:
        own = f.read()
    with open(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    for encoder in (Encoder(own), Encoder(own, ranks)):
        assert encoder.encode(TEXTS) == want
        assert encoder.encode(TEXTS) == want


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_fill_respects_capacities(rule):
    counts = {3: 50, 10: 7, 17: 4, 40: 9, 64: 2}
    done = Counter()
    for times, entries in fill(counts, 64, 8, 64 * 64, rule):
        assert sum(a * n for a, n in entries) <= 64 and sum(n for _, n in entries) <= 8
        for a, n in entries:
            done[a] += times * n
    assert done == counts


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    model.encode_special_tokens = True
    docs = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(900, None), (901, "same"), (901, "same"), (None, "no id")]
    df = spark.createDataFrame([(a, b, 5) for a, b in docs], "doc_id long, text string, length int").repartition(4)
    rows = best_fit_packing(df, vocabulary()).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for d, t in docs:
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[d], key=lambda r: r.piece)
        if d == 901:
            assert len(own) == 2
            continue
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_sharding_laws(spark):
    docs = [(i, f"t{i}") for i in range(150)] + [(1000 + i, "big") for i in range(120)] + [(2000 + i, f"pair{i // 3}") for i in range(90)] + [(5000, None), (5001, None), (5002, ""), (5003, ""), (1000, "big")]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, shard int").repartition(5)
    rows = balanced_shards(df).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    count = Counter(r.shard for r in rows)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(8))
    for s, n in count.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    text = dict(docs)
    for r in rows:
        assert r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
    spread = defaultdict(set)
    for r in rows:
        if text[r.doc_id] is not None:
            spread[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for t, s in spread.items() if t.startswith("pair")) == 0
    big = Counter(r.shard for r in rows if text[r.doc_id] == "big")
    assert max(big.values()) >= 30


@pytest.mark.parametrize("texts, groups", [(1, 20_000), (3, 20_000), (40, 5)])
def test_sharding_of_few_texts(spark, texts, groups):
    """Nearly all rows are copies of few texts: shards start above their room."""
    docs = [(i, f"t{i % texts}") for i in range(3001)] + [(9000 + i, f"lone{i}") for i in range(5)]
    rows = balanced_shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), groups_in_bucket=groups).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit_packing(df, vocabulary()).count() == 0 and balanced_shards(df).count() == 0

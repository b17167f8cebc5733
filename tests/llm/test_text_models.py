"""Fingerprints, decontamination and toxicity against brute force and planted cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np

from wayfare.llm.decontaminate import Index, contamination, words_of
from wayfare.llm.fingerprints import edit, near_duplicates, neighbours
from wayfare.llm.jaccard_join import shingle_set
from wayfare.llm.toxicity import toxicity


def words(r, n, most=400):
    return " ".join(f"w{r.randrange(most)}" for _ in range(n))


def test_neighbours(spark):
    r = random.Random(4)
    docs = [(i * 5 % 211, words(r, r.choice([0, 1, 4, 30, 300]))) for i in range(200)] + [(9000, None), (9001, ""), (9002, "éü x")]
    df = spark.createDataFrame([(a, b, 3) for a, b in docs], "doc_id long, text string, n_chars int").repartition(3)
    got = {x.doc_id: x for x in neighbours(df).collect()}
    docs = sorted((d, t or "") for d, t in docs)
    assert len(got) == len(docs)
    errors = []
    for (d, t), (e, u) in zip(docs, docs[1:] + docs[:1]):
        edited = edit(t, u)
        x = got[d]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and len(edited) <= len(t)
        for other, near in ((edited, x.near_edited), (u, x.near_next)):
            a, b = shingle_set(t.encode()), shingle_set(other.encode())
            both = len(np.intersect1d(a, b))
            errors.append(abs(near - (both / (len(a) + len(b) - both) if len(a) + len(b) else 1)))
        assert x.near_next == np.mean([x.fingerprint[4 * i : 4 * i + 4] == got[e].fingerprint[4 * i : 4 * i + 4] for i in range(128)])
    assert np.mean(errors) < 0.05 and max(errors) < 0.25
    assert neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = neighbours(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert one[0].doc_id is None and one[0].near_next == 1.0


def test_near_duplicates(spark):
    r = random.Random(8)
    base = words(r, 200).split()
    near = base[:100] + ["zz"] + base[101:]
    docs = [(5, " ".join(base)), (7, " ".join(near)), (8, " ".join(base)), (9, words(r, 200)), (10, ""), (11, None)]
    got = dict(tuple(x) for x in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == {5: 5, 7: 5, 8: 5, 9: 9, 10: 10, 11: 11}


def test_near_duplicates_against_brute_force(spark):
    """Chains whose ends are far apart, groups around a hub that is near to none of them, and copies."""
    r = random.Random(18)
    docs = [(0, None), (1, ""), (2, "one two"), (3, "one two")]
    for g in range(25):
        own = words(r, 120, 5000).split()
        hub = own[:]
        for k in range(12):  # some 0.7 near to the hub, nearer to each other
            if k == 5:
                own = hub[:]
            at = r.randrange(120)
            own[at] = f"x{g}_{k}"
            docs.append((100 + g * 20 + k, " ".join(own)))
    r.shuffle(docs)
    sets = {d: set(shingle_set((t or "").encode()).tolist()) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = dict(tuple(x) for x in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())
    wrong = [d for d in ids if got[d] != root(d)]
    assert len({root(d) for d in ids}) < len(ids) - 50 and len(wrong) <= len(ids) // 50


def test_kernel_equals_plain_sums():
    """Kernel values against a sum over all pairs of letter triples."""
    from itertools import combinations

    from wayfare.llm.toxicity import DECAY, FLOOR, SPAN, Kernel, features

    def plain(x, y):
        total = 0.0
        for i in combinations(range(len(x)), 3):
            for j in combinations(range(len(y)), 3):
                if [x[k] for k in i] == [y[k] for k in j] and i[2] - i[0] < SPAN and j[2] - j[0] < SPAN:
                    total += DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
        return total

    r = random.Random(2)
    strings = [bytes([31, *(r.randrange(6) for _ in range(r.randint(3, 8)))]) for _ in range(12)]
    marks = strings[:4]
    value = Kernel(marks).values(strings)
    for i, x in enumerate(strings):
        for j, z in enumerate(marks):
            share = plain(x, z) / plain(z, z)
            assert abs(value[i, j] - (min(1.0, share) if share >= FLOOR else 0.0)) < 1e-4
            cosine = plain(x, z) / (plain(x, x) * plain(z, z)) ** 0.5
            assert abs(sum(v * features(z).get(k, 0) for k, v in features(x).items()) - cosine) < 1e-4


def test_wand_finds_every_item_above_threshold():
    r = random.Random(3)
    items = [(i, words(r, r.randint(3, 40), 60)) for i in range(90)]
    df = Counter(w for _, t in items for w in set(words_of(t)))
    index = Index(items, len(items), df, 20.0)
    for _ in range(60):
        terms = set(words(r, r.randint(1, 60), 60).split())
        score = [sum(dict(zip(index.items[t], index.impact[t])).get(i, 0) for t in terms if t in index.items) for i in range(90)]
        for threshold in (0.2, 0.5, 0.8):
            want = {i: s for i, s in enumerate(score) if s >= threshold - 1e-9}
            got = dict(index.search(terms, threshold))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
            blocks = sorted({i // index.block for i in want} | {3, 7})
            assert dict(index.search(terms, threshold, blocks)).keys() == {i for i in range(90) if i in want}
    # a rare threshold leaves most items unscored
    index.skipped = index.scored = 0
    for _ in range(40):
        index.search(set(words(r, 30, 60).split()), 0.8)
    assert index.skipped > 100 and index.scored < 40 * 90 / 4


def passages(text, longest):
    own = words_of(text)
    size = max(16, 2 * longest)
    return [own[a : a + size] for a in range(0, max(1, len(own) - size // 2), size // 2)]


def test_contamination_equals_brute_force(spark):
    """Every passage against every item: BM25 as a share of the item's own score, then question and answer overlap."""
    r = random.Random(16)
    items = [(i, words(r, 8 + i % 25, 300)) for i in range(40)]
    docs = []
    for i in range(150):
        own = words(r, r.randint(0, 120), 300).split()
        for _ in range(r.randint(0, 2)):
            piece = items[r.randrange(40)][1].split()
            piece = [w if r.random() < 0.9 else "zz" for w in piece][: r.randint(3, 40)]
            at = r.randint(0, len(own))
            own[at:at] = piece
        docs.append((i, " ".join(own)))
    df = Counter(w for _, t in items for w in set(words_of(t)))
    mean = sum(len(words_of(t)) for _, t in items) / 40
    longest = max(len(words_of(t)) for _, t in items)
    weight = {}
    for i, t in items:
        tf = Counter(words_of(t))
        raw = {w: np.log(1 + (40 - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words_of(t)) / mean)) for w, f in tf.items()}
        weight[i] = {w: x / sum(raw.values()) for w, x in raw.items()}

    def grams(own, n):
        n = min(n, len(own))
        return {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()

    want = {}
    for d, t in docs:
        for own in passages(t, longest):
            for i, text in items:
                score = sum(x for w, x in weight[i].items() if w in own)
                if score < 0.6 - 1e-9:
                    continue
                full = words_of(text)
                cut = min(len(full), max(1, round(len(full) * 0.6)))
                parts = [full[:cut], full[cut:]]
                share = [len(grams(x, 3) & grams(own, min(3, len(x)))) / len(grams(x, 3)) if x else 1.0 for x in parts]
                if min(share) >= 0.6 and score > want.get((d, i), (0,))[0]:
                    want[d, i] = (score, *share)
    got = {(x.doc_id, x.item_id): (x.score, x.question_overlap, x.answer_overlap) for x in contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_contamination(spark):
    r = random.Random(6)
    items = [(i, words(r, 20 + i % 30, 5000)) for i in range(60)] + [(60, None), (61, "")]
    docs = [(i, words(r, r.randint(1, 400), 5000)) for i in range(80)]
    planted = [(1000 + i, words(r, 50 * i, 5000) + " " + items[i][1].upper() + ". " + words(r, 30, 5000)) for i in range(20)]
    docs += planted + [(2000, None), (2001, ""), (1000, planted[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 2000):
        got = sorted((x.doc_id, x.item_id) for x in contamination(df, bench, index_bytes=size, shelf_bytes=1500).collect())
        assert got == sorted([(1000 + i, i) for i in range(20)] + [(1000, 0)])
    assert contamination(df, bench.limit(0)).count() == 0


def test_toxicity(spark):
    r = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        own = words(r, 40, 300).replace("w", "l").split()
        own = ["".join(chr(97 + int(c)) for c in w[1:]) + r.choice(["ing", "er", "on"]) for w in own]
        toxic = i % 3 == 0
        if toxic:
            word = r.choice(["dreckwort", "blimpkopf"])
            k = r.randrange(2, 7)
            own[r.randrange(40)] = r.choice([word, word.upper(), word[:k] + "." + word[k:], word + "s"]) if i % 5 else " ".join(word)
        docs.append((i, " ".join(own)))
        labels.append((i, 1 if toxic else 0))
    docs += [(5000, None), (5001, "")]
    labels += [(None, 1), (5000, None)]
    df = spark.createDataFrame([(a, b, 2.0) for a, b in docs], "doc_id long, text string, score double").repartition(3)
    got = {x.doc_id: x for x in toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    right = np.mean([got[i].predicted == (i % 3 == 0) for i in held])
    assert right > 0.97 and got[5000].predicted == 0 and got[5000].score == got[5001].score
    none = toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {x.score for x in none} == {0.0}

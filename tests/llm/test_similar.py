"""Near duplicates by five-word similarity against all pairs."""

import random

import numpy as np

import corpus_pipeline as P
from tideline.llm import similar, simhash


def _sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append(set(zip(*(w[k:] for k in range(5)), strict=False)) or {tuple(w)})
    return out


def _groups(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(30, 150))]
        for edits in (0, 1, 1, 2, 3):  # up to 15 shingles change
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return [*out, "two words", "two words", "two others"]


def test_all_pairs_of_five_word_similarity_are_found(spark):
    texts = _texts()
    sets = _sets(texts)
    fp = simhash.fingerprint_texts([t.encode() for t in texts])
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert sum(int(np.bitwise_count(fp[i] ^ fp[j])) > 3 for i, j in near) > 50  # which three bits do not link
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    label = _groups(sets)
    assert {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(df).collect()} == dict(enumerate(label))
    assert sorted(r["doc_id"] for r in P.near_duplicate_stage(spark, df, "").collect()) == sorted(set(label))


def test_blocks_of_a_large_bucket_give_the_same_groups(spark):
    texts = _texts()
    sets = {similar.set_hash(s): s for s in (similar.shingle_set(t.encode()) for t in texts)}
    as_long = lambda x: int(np.uint64(x).view(np.int64))
    held = spark.createDataFrame([(1, as_long(h), as_long(h)) for h in sets], "key long, h long, root long")
    table = spark.createDataFrame([(as_long(h), s.view(np.int64).tolist()) for h, s in sets.items()], "h long, set array<long>")
    links = [{(r["a"], r["b"]) for r in similar.bucket_links(held, table, 0.8, block).collect()} for block in (512, 20)]
    one = _sets(texts)
    at = {as_long(similar.set_hash(similar.shingle_set(t.encode()))): i for i, t in enumerate(texts)}
    for found in links:
        label = {h: h for h in at}
        for a, b in found:
            label = {h: label[b] if x == label[a] else x for h, x in label.items()}
        want = dict(enumerate(_groups(one)))
        assert len(set(label.values())) == len({want[i] for i in at.values()})

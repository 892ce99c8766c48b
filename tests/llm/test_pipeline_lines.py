"""Repeated lines of large sources."""

import random

import corpus_pipeline as P


def test_passages_far_below_a_tenth_of_a_source_go_and_whole_copies_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, copy = (" ".join(word() for _ in range(60)) for _ in range(2))
    texts = [f"{word()} {word()}\n{passage}" if i % 100 == 0 else f"{word()} {word()} {word()}" for i in range(1200)]  # in 12 of 1200
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *[copy] * 8])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = {r["doc_id"]: r["text"] for r in P.line_stage(spark, df, "").collect()}
    assert out == {i: t.removesuffix("\n" + passage) for i, t, *_ in rows}

"""Each stage of the pipeline against a plain version, on one small table."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tideline.llm import mixing, pieces, toxicity

rng = random.Random(8)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(150)]


def text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(240):
        t = "shared footer line\n" * (i % 3 == 0) + text(rng.randint(15, 60)) + ("\nyou scum " + text(3)) * (i % 8 == 0)
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    rows += [(300 + i, rows[i * 5 + 1][1], "en", "s1", 0) for i in range(20)]  # exact copies
    rows += [(400 + i, rows[i * 7 + 2][1] + " tail", "en", "s2", 0) for i in range(20)]  # nearly
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", F.lit(1).alias("quality"), F.col("text").contains("scum").cast("int").alias("toxic")).write.parquet(str(folder / "labels.parquet"))
    docs.write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_toxic_documents_go(spark, docs, sf_dir):
    out = {r["doc_id"] for r in P.toxicity_stage(spark, docs, sf_dir).collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert out == {r["doc_id"] for r in toxicity.score(docs, model).filter("score < 0.5").collect()}
    toxic = {r["doc_id"] for r in docs.filter(F.col("text").contains("scum")).collect()}
    clean = {r["doc_id"] for r in docs.collect()} - toxic
    assert len(out & toxic) <= 2 and len(clean - out) <= 2


def test_lines(spark, docs, sf_dir):
    given = docs.collect()
    pages, holding = Counter(r["source"] for r in given), Counter()
    for r in given:
        holding.update({(r["source"], x.strip()) for x in r["text"].split("\n")})
    bad = {k for k, n in holding.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    assert bad
    out = {r["doc_id"]: r for r in P.line_stage(spark, docs, sf_dir).collect()}
    for r in given:
        want = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip()) not in bad)
        assert out[r["doc_id"]]["text"] == want
        assert out[r["doc_id"]]["n_chars"] == (len(want) if want != r["text"] else r["n_chars"])


def test_one_of_each_group_stays(spark, docs, sf_dir):
    """Groups by brute force over five-word shingle sets and 0.8 of them in common, as near-duplicate stages are to link."""
    given = sorted(docs.collect(), key=lambda r: r["doc_id"])
    sets = []
    for r in given:
        w = r["text"].lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(given)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] > label[i] and len(a & b) >= 0.8 * len(a | b):
                    label[j], changed = label[i], True
    want = sorted(given[k]["doc_id"] for k in set(label))
    assert sorted(r["doc_id"] for r in P.near_duplicate_stage(spark, docs, sf_dir).collect()) == want
    assert len(want) <= 260


def test_rows_of_one_document(spark, docs, sf_dir):
    a = (1, "one two three four five six", "en", "s2", 5)
    rows = [a, a, (1, a[1], "en", "s1", 5), (1, a[1], None, "s9", 5), (2, "quite another text in here now", None, None, None), (2, "quite another text in here now", None, None, None)]
    df = spark.createDataFrame(rows, docs.schema)
    out = P.near_duplicate_stage(spark, df, sf_dir).collect()
    assert sorted((r["doc_id"], r["lang"], r["source"]) for r in out) == [(1, None, "s9"), (2, None, None)]


def test_mixing_repeats_rows(spark, docs, sf_dir):
    out = Counter(r["doc_id"] for r in P.mixing_stage(spark, docs, sf_dir).collect())
    assert out == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]})


def test_pieces_come_back(spark, docs, sf_dir):
    back = {r["doc_id"]: r["text"] for r in pieces.decode(P.pieces_stage(spark, docs, sf_dir)).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_run_is_the_stages_in_order(spark, sf_dir):
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES:
        kept = stage(spark, kept, sf_dir).persist()
    assert sorted((r["doc_id"], r["ids"]) for r in P.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["ids"]) for r in kept.collect())

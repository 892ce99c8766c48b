"""Toxicity: a noisy-channel decoder restores disguised words, a linear model scores the restored text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import durable, map_batches, one_thread, table, tidied

# What a written character may stand for, and what may stand between the letters of a word.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
GAPS = " ._-*"
WILD = "*#"
#: Log probabilities of the channel: a sign for a letter, a letter drawn out, a gap put in, a letter hidden.
LEET_COST, REPEAT_COST, GAP_COST, WILD_COST = -1.5, -1.0, -0.5, -4.0
#: Labelled rows, in the order of a hash of their id, on which the linear model is fitted, and how many features it may have.
SAMPLE, FEATURES = 12_000, 1_500
#: Standard deviations by which a feature's toxic texts differ from what their share in the sample gives.
LEAST_Z = 3.0
#: Tokens whose features a worker remembers, and the most characters of such a token.
REMEMBER, REMEMBERED_CHARS = 200_000, 64
#: Runs of characters whose readings are open at once; see restore().
OPEN = 4096

#: Symbols of the character model: 0 ends a word, 1 to 26 letters, 27 any byte of another letter, 28 a digit.
SYMBOL = bytes(27 if b >= 0x80 else 28 if 48 <= b <= 57 else (b | 32) - 96 if 97 <= (b | 32) <= 122 else 0 for b in range(256))
BASE = 32


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each three symbols follow each other in all texts; at most BASE ** 3 rows."""
    source = docs.select(F.col(text_col).cast("binary").alias("_text")).filter("_text is not null")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BASE**3, np.int64)
        for b in it:
            for text in b.column(0).to_pylist():
                for at in range(0, len(text), 1 << 22):  # two symbols before each piece, but for the first
                    s = np.frombuffer(text[max(0, at - 2) : at + (1 << 22)].translate(SYMBOL), np.uint8).astype(np.int32)
                    s = np.concatenate(([0] if at == 0 else [], s, [0] if at + (1 << 22) >= len(text) else [])).astype(np.int32)
                    if len(s) > 2:
                        total += np.bincount((s[:-2] * BASE + s[1:-1]) * BASE + s[2:], minlength=BASE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    return map_batches(source, batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """log P(c | a, b), each order backed off to the one below with the weight of so many observations."""
    n3 = counts.reshape(BASE, BASE, BASE).astype(float)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 0.5) / (n1 + 0.5).sum()
    p2 = (n2 + weight * p1) / (n2.sum(1, keepdims=True) + weight)
    p3 = (n3 + weight * p2[None]) / (n3.sum(2, keepdims=True) + weight)
    return np.log(p3)


_RUN = re.compile(r"(.)\1*", re.S)


def _readings(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n characters c may stand for, and the channel's log probability."""
    ways: dict[str, float] = {}
    if c.isalpha():
        ways[c * min(n, 2)] = 0.0 if n <= 2 else REPEAT_COST
        if n > 1:
            ways[c] = REPEAT_COST
    else:
        if not (c in WILD and n > 1):
            ways[c * min(n, 2)] = 0.0
        for letter in LEET.get(c, ""):
            ways[letter] = LEET_COST + (REPEAT_COST if n > 1 else 0)
            if n > 1:
                ways[letter * 2] = 2 * LEET_COST
        if c in GAPS:
            ways[""] = GAP_COST
        if c in WILD and n == 1:
            ways |= dict.fromkeys("aeiou", WILD_COST)
        ways = ways or {c: 0.0}
    return list(ways.items())


def _spoken(back: tuple | None) -> str:
    out = []
    while back is not None:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out))


def restore(text: str, lm: list[list[list[float]]]) -> str:
    """The likeliest reading of lower-case text as words, by Viterbi search over the lattice of its readings.

    A run of one letter may be read as one or two of it, a sign as the letters it stands for or as itself, a gap between letters as nothing.
    What stands before two plain letters is decided there and leaves the lattice; OPEN runs without any are decided by the best reading so
    far, so that a token of any length takes bounded memory.
    """
    done: list[str] = []
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    still = 0
    for m in _RUN.finditer(text):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        ways = _readings(m[1], len(m[0]))
        for (a, b), (score, back) in states.items():
            for out, cost in ways:
                x, y, s = a, b, score + cost
                for byte in out.encode().translate(SYMBOL):
                    s += lm[x][y][byte]
                    x, y = y, byte
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (out, back))
        still += 1
        if len(after) == 1 or still == OPEN:
            at, (_, back) = max(after.items(), key=lambda x: x[1][0])
            done.append(_spoken(back))
            after, still = {at: (0.0, None)}, 0
        states = after
    _, back = max(((s + lm[a][b][0], back) for (a, b), (s, back) in states.items()), key=lambda x: x[0])
    return "".join(done) + _spoken(back)


#: What is cut from the ends of a token; of signs that may stand for letters only long runs.
PUNCTUATION = """.,;:!?"'()[]{}<>%&*#-_/\\|^~=+`«»„“”…"""
_ODD = re.compile(r"[0-9@$!|+(<€£*#._-]|([^\W\d_])\1\1")
_DRAWN = re.compile(r"(.)\1\1")
_WORD = re.compile(r"[^\W_]+")
_DOUBLED = re.compile(r"([^\W\d_])\1")
#: Single characters that stand apart: the least run is three, the longest 64; longer ones are read in parts.
_SPACED = re.compile(r"(?<!\S)\S(?:[ ._*-]{1,3}\S){2,63}(?!\S)")


class Reader:
    """Texts -> sets of features: 32-bit hashes of the restored words, and of their first four and five letters."""

    def __init__(self, lm: np.ndarray) -> None:
        self.lm = lm.tolist()
        self.known: dict[str, tuple[int, ...]] = {}

    def read(self, token: str) -> str:
        core = token.strip(PUNCTUATION)
        if core.isalpha() and not _DRAWN.search(core):
            return core
        if core.startswith(("$$$", "@@@")) or core.endswith(("$$$", "@@@")):
            core = core.strip("$@" + PUNCTUATION)
        return restore(core, self.lm) if _ODD.search(core) and any(map(str.isalpha, core)) else core

    def of_token(self, token: str) -> tuple[int, ...]:
        """Of the token as it is read, and, if that has doubled letters, also of its reading with the likelier of one and two."""
        word = self.read(token)
        out = self.of_words(word)
        if word.isalpha() and _DOUBLED.search(word) and (other := restore(word, self.lm)) != word:
            out += self.of_words(other)
        return out

    def of_words(self, text: str) -> tuple[int, ...]:
        out = []
        for w in (text,) if text.isalpha() else _WORD.findall(text):
            out.append(crc32(w.encode()))
            if len(w) > 3:
                out += (crc32(f"{w[:4]}-".encode()), crc32(f"{w[:5]}-".encode()))
        return tuple(out)

    def features(self, text: str | None) -> set[int]:
        text = (text or "").lower()
        known, found = self.known, set()
        for token in set(text.split()):
            if (f := known.get(token)) is None:
                f = self.of_token(token)
                if len(known) >= REMEMBER:
                    known.clear()
                if len(token) <= REMEMBERED_CHARS:
                    known[token] = f
            found.update(f)
        for m in _SPACED.findall(text):
            found.update(self.of_words(restore(m, self.lm)))
        return found


class Scorer(Reader):
    """A reader that keeps the features of a linear model only."""

    def __init__(self, lm: np.ndarray, weights: dict[int, float], bias: float) -> None:
        super().__init__(lm)
        self.weights, self.bias = weights, bias

    def of_words(self, text: str) -> tuple[int, ...]:
        return tuple(f for f in super().of_words(text) if f in self.weights)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(self.features(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_linear(rows: list[list[int]], y: np.ndarray, n: int, l2: float = 0.1, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features 0 to n - 1, by Nesterov's method with a step from the bound on the curvature."""
    x = np.zeros((len(rows), n + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, n] = 1
    v = np.ones(n + 1, np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    rate = 1 / (0.25 * float(np.linalg.norm(x @ v) ** 2) * 1.05 + l2)
    w = at = np.zeros(n + 1, np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        g = x.T @ (p - y) + l2 * np.append(at[:n], 0)
        to = at - rate * g.astype(np.float32)
        w, at = to, to + k / (k + 3) * (to - w)
    return w[:n], float(w[n])


def held_out(id_: str = "doc_id", remainder: int = 0):
    return F.pmod(F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit(""))), F.lit(5)) == remainder


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES) -> tuple[np.ndarray, dict[int, float], float]:
    """Character model over all texts, and the linear model over at most `sample` labelled rows that aren't held out.

    Null labels and ids are passed over; of several labels for an id the largest counts. Without labels of both kinds every text gets
    the base rate.
    """
    counts = np.zeros(BASE**3, np.int64)
    for gram, n in count_grams(docs, text_col).collect():
        counts[gram] = n
    lm = language_model(counts)
    reader = docs.sparkSession.sparkContext.broadcast(lm.astype(np.float32))
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y is not null and _id is not null").filter(~held_out("_id"))
    chosen = F.broadcast(chosen.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").select("_y", "_text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(reader.value)
        for b in it:
            found = [sorted(r.features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["_y", "f"])

    rows = durable(map_batches(rows, batches, "_y int, f array<long>"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not toxic or toxic == n:  # nothing to tell apart
        return lm, {}, float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    share = toxic / n
    told = rows.select("_y", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("_y").alias("k"))
    z = F.abs(F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = [r[0] for r in told.filter("n >= 3").filter(z >= LEAST_Z).orderBy(z.desc(), "f").limit(features).select("f").collect()]
    place = {f: i for i, f in enumerate(best)}
    kept = F.array_intersect("f", F.lit(best).cast("array<bigint>")) if best else F.array().cast("array<bigint>")
    given = sorted((y, sorted(place[f] for f in fs)) for y, fs in rows.select("_y", kept).collect())
    w, bias = fit_linear([r for _, r in given], np.array([y for y, _ in given], np.float32), len(best))
    return lm, {f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-4}, bias


def score(docs: DataFrame, model: tuple[np.ndarray, dict[int, float], float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score) of every row; null and empty texts get the score of a text without features."""
    lm, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((lm.astype(np.float32), weights, bias))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    source = docs.select(*keep, F.col(text_col).alias("_text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in it:
            scores = [scorer.score(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return map_batches(source, batches, schema)


def score_column(spark: SparkSession, model: tuple[np.ndarray, dict[int, float], float]):
    """The score as a function of a text column, for plans that go on with the row."""
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), *model[1:]))

    def scores(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*sent.value)
        for texts in it:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    @F.pandas_udf("double")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(scores)(it)

    def column(text: str):
        with one_thread(spark):
            return scored(text)

    return column


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}

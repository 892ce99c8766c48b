"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import durable, map_batches, table

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
# Phrases of legal notices, lower case.
NOTICES = (b"licensed under", b"all rights reserved", b"copyright", b"public license", b"terms of use", b"cookie", b"privacy policy", b"released under", b"subscribe")
#: Labelled rows, in the order of a hash of their id, on which the field is fitted, and the lines that they may have together: a row with which there
#: would be more is passed over.
SAMPLE, SAMPLE_LINES = 4_000, 200_000
#: Different lines of the sample before, or after, which a boilerplate line stands, at least. (Near copies of a text share lines too, but beside the same ones.)
SHARED = 5
#: The share of words in content lines from which a text is kept.
CONTENT_SHARE = 0.5
#: Bytes of text that are measured at once, if one text is no longer than that; bytes whose words, and lines whose features, are in memory as objects.
CHUNK, PIECE, BLOCK = 4 << 20, 1 << 18, 1 << 13

#: White space, and the bytes that go on with a character: what is left is one byte for each code point of the words.
UNCOUNTED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
NAMES = ["bias", "words", "symbols", "upper", "digits", "marks", "repeats", "length", "stop", "start", "again", "notice", "short", "ends"]


_SPACE = re.compile(rb"[ \t\n\v\f\r]")


def word_lists(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of some bytes, a piece of about `size` at a time."""
    at = 0
    while len(data) - at > size:
        found = _SPACE.search(data, at + size)
        to = found.start() if found else len(data)
        yield data[at:to].split()
        at = to
    yield data[at:].split() if at else data.split()


def line_features(line: bytes, again: bool) -> tuple[list[float], int]:
    """Features of a line and its words."""
    n, k, odd, known = len(line), 0, 0, set()
    for words in word_lists(line):
        k += len(words)
        known.update(words)
        odd += sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,") for w in words)
    if not k:
        return [], 0
    low = line.lower()
    last = line.rstrip()[-1:]
    return [
        1.0,
        min(log1p(k), 5.0) / 5,
        (n - len(line.translate(None, SYMBOLS))) / n * 4,
        (n - len(line.translate(None, UPPER))) / n,
        (n - len(line.translate(None, DIGITS))) / n,
        (n - len(line.translate(None, b"!?"))) / n * 4,
        1 - len(known) / k,
        min(n / k, 20.0) / 10,
        float(last in b".!?:;"),
        float(line.lstrip()[:1].isupper() or line.lstrip()[:1] >= b"\x80"),
        float(again),
        float(any(x in low for x in NOTICES)),
        float(k <= 3),
        odd / k,
    ], k


def line_blocks(text: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], int]]:
    """Of the lines that have a word, some at a time: features, words, the lines, and how many of these equal an earlier one."""
    text, seen, at = text or b"", set(), 0
    features, sizes, lines, again = [], [], [], 0

    def block() -> tuple[np.ndarray, np.ndarray, list[bytes], int]:
        return np.array(features, np.float32).reshape(-1, len(NAMES)), np.array(sizes, np.int32), lines, again

    while at < len(text):
        to = text.find(b"\n", at)
        line = text[at : to if to >= 0 else len(text)]
        at = to + 1 if to >= 0 else len(text)
        known = line in seen
        row, k = line_features(line, known)
        if not k:
            continue
        seen.add(line)
        features.append(row), sizes.append(k), lines.append(line)
        again += known
        if len(sizes) == BLOCK:
            yield block()
            features, sizes, lines, again = [], [], [], 0
    yield block()


class Field:
    """Labels 0 (boilerplate) and 1 (content). weights: features by labels; change: label by next label; first: of the first line."""

    def __init__(self, weights: np.ndarray, change: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.change, self.first = weights, change, first

    @staticmethod
    def _laid(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences by falling length: their order and starts; how many go on at each step."""
        sizes = np.array(sizes, np.int64)
        order = np.argsort(-sizes, kind="stable")
        going = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left") if len(sizes) else np.empty(0, np.int64)
        return order, (np.cumsum(sizes) - sizes)[order], going

    def decode(self, x: np.ndarray, sizes: list[int]) -> np.ndarray:
        """The likeliest label of every line, from its features."""
        return self.path(x @ self.weights, sizes)

    def path(self, e: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Viterbi, all sequences at once, line by line, from what the features of each line speak for."""
        _, starts, going = self._laid(sizes)
        back = np.zeros((len(e), 2), np.int8)
        score = np.empty((len(starts), 2))
        for t, n in enumerate(going):
            at = starts[:n] + t
            if t == 0:
                score[:n] = e[at] + self.first
                continue
            ways = score[:n, :, None] + self.change
            back[at] = ways.argmax(1)
            score[:n] = ways.max(1) + e[at]
        out = np.zeros(len(e), np.int8)
        label = score.argmax(1).astype(np.int8) if len(score) else np.empty(0, np.int8)
        for t in range(len(going) - 1, -1, -1):
            at = starts[: going[t]] + t
            out[at] = label[: going[t]]
            label[: going[t]] = back[at, label[: going[t]]]
        return out

    def slope(self, x: np.ndarray, y: np.ndarray, sizes: list[int]) -> tuple[float, list[np.ndarray]]:
        """Log likelihood of the labels and its gradient, by forward and backward sums."""
        _, starts, going = self._laid(sizes)
        e = x @ self.weights
        a, b = np.empty((len(x), 2)), np.zeros((len(x), 2))
        for t, n in enumerate(going):
            at = starts[:n] + t
            a[at] = e[at] + (self.first if t == 0 else np.logaddexp.reduce(a[at - 1][:, :, None] + self.change, axis=1))
        for t in range(len(going) - 1, 0, -1):
            at = starts[: going[t]] + t
            b[at - 1] = np.logaddexp.reduce(self.change + (e[at] + b[at])[:, None, :], axis=2)
        head = starts[: going[0]]
        whole = np.logaddexp.reduce(a + b, axis=1)  # of a line's text
        own = np.exp(a + b - whole[:, None])
        truth = np.eye(2)[y]
        follows = np.ones(len(x), bool)
        follows[head] = False
        t = np.flatnonzero(follows)
        pair = np.exp(a[t - 1][:, :, None] + self.change + (e[t] + b[t])[:, None, :] - whole[t][:, None, None])
        seen = truth[t - 1][:, :, None] * truth[t][:, None, :]
        gained = (e * truth).sum() + (self.change * seen).sum() + (self.first * truth[head]).sum() - whole[head].sum()
        return gained, [x.T @ (truth - own), (seen - pair).sum(0), (truth[head] - own[head]).sum(0)]


def fit_field(x: np.ndarray, y: np.ndarray, sizes: list[int], steps: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Field:
    """By Adam over the whole sample."""
    field = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2))
    parts = [field.weights, field.change, field.first]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for k in range(1, steps + 1):
        _, grads = field.slope(x, y, sizes)
        for p, g, a, b in zip(parts, grads, m, v, strict=True):
            g = g / len(x) - l2 * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return field


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Field:
    """From at most `sample` labelled rows with at most `sample_lines` lines. A line is boilerplate if its text is of low quality, if it repeats an earlier
    line, or if it stands before or after SHARED different lines in the sample.

    Lines of low texts that look like those of good texts (by a field of single lines fitted first) count as content. Null labels and
    ids are passed over; of several labels for an id the largest counts. Without labels of both kinds every line is content.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y is not null and _id is not null")
    chosen = F.broadcast(chosen.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(chosen, "_id")
    rows = rows.select(F.xxhash64("_id").alias("_k"), F.xxhash64("_text").alias("_t"), "_y", "_text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in it:
            n, f, h = [], [], []
            for text in b.column(3).to_pylist():
                parts, total = [], 0
                for x, _, lines, _ in line_blocks(text):
                    total += len(x)
                    parts.append((x.tobytes(), np.array([xxhash.xxh64_intdigest(s.strip()) for s in lines], np.uint64).tobytes()))
                    if total > sample_lines:
                        parts = []
                        break
                n.append(total)
                f.append(b"".join(p[0] for p in parts))
                h.append(b"".join(p[1] for p in parts))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n), pa.array(f, pa.binary()), pa.array(h, pa.binary())], names=["_k", "_t", "_y", "n", "f", "h"])

    found = durable(map_batches(rows, batches, "_k long, _t long, _y int, n long, f binary, h binary").filter("n > 0"))
    order = Window.orderBy("_k", "_t")  # of the sample: the sums of what is taken stay within its lines
    taken = found.withColumn("upto", F.sum("n").over(order)).filter(F.col("upto") <= sample_lines).orderBy("_k", "_t").select("_y", "n", "f", "h").toArrow()
    label, sizes = (taken.column(c).to_numpy() for c in ("_y", "n"))
    if len(set(label.tolist())) < 2:
        w = np.zeros((len(NAMES), 2))
        w[0, 1] = 1
        return Field(w, np.zeros((2, 2)), np.zeros(2))
    x = np.frombuffer(b"".join(taken.column("f").to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(float)
    line = np.frombuffer(b"".join(taken.column("h").to_pylist()), np.uint64)
    first = np.repeat(np.arange(len(sizes)), sizes)
    joined = np.flatnonzero(first[1:] == first[:-1])  # lines that go on with another of their text
    shared = np.zeros(len(line), bool)
    for own, beside in ((joined, joined + 1), (joined + 1, joined)):
        held, n = np.unique(np.unique(np.stack((line[own], line[beside])), axis=1)[0], return_counts=True)
        shared |= np.isin(line, held[n >= SHARED])
    good, poor = np.repeat(label, sizes), shared | (x[:, NAMES.index("again")] > 0)
    y = ((good > 0) & ~poor).astype(int)
    alone = fit_field(x, y, [1] * len(x), steps=100)
    e = x @ alone.weights + alone.first
    y |= (good == 0) & (e[:, 1] - e[:, 0] > 2.0) & ~poor
    return fit_field(x, y, sizes.tolist())


def repeated(ids: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text (word ids one after another): how many words lie in windows that stand twice or more in it."""
    n = len(ids)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    start = np.flatnonzero(np.arange(n) + window <= np.repeat(np.cumsum(sizes), sizes))
    if not len(start):
        return np.zeros(len(sizes), np.int64)
    mixed = np.random.default_rng(5).integers(0, 1 << 64, int(ids.max()) + 1, np.uint64)
    h = doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(window):
        h = (h * np.uint64(0x100000001B3)) ^ mixed[ids[start + k]]
    order = np.argsort(h, kind="stable")
    a, b = start[order[:-1]], start[order[1:]]
    same = np.flatnonzero(h[order[:-1]] == h[order[1:]])
    a, b = a[same], b[same]
    ok = doc[a] == doc[b]
    for k in range(window):  # equal hashes are no proof
        ok &= ids[a + k] == ids[b + k]
    hit = np.zeros(n + 1, bool)
    hit[a[ok]] = hit[b[ok]] = True
    edge = np.zeros(n + window + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge)[:n] > 0
    return np.bincount(doc[covered], minlength=len(sizes))


OUT = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "content_share": pa.float64()}


def measure(texts: list[bytes | None], field: Field) -> list[pa.Array]:
    """The columns of OUT. What is held for a text is numbers: one a word, four a line."""
    known: dict[bytes, int] = {}
    ids, sizes, again, counts, e, per = [], [], [], [], [], []
    for t in texts:
        n = 0
        for words in word_lists(t or b""):
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            n += len(words)
        sizes.append(n)
        lines, same = 0, 0
        for x, k, _, equal in line_blocks(t):
            e.append(x @ field.weights)
            per.append(k)
            lines += len(k)
            same += equal
        counts.append(lines)
        again.append(same)
    del known
    chars = [len(t.translate(None, UNCOUNTED)) if t else 0 for t in texts]
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts]
    sizes = np.array(sizes, np.int64)
    label = field.path(np.concatenate(e), counts)
    content = np.bincount(np.repeat(np.arange(len(texts)), counts), label * np.concatenate(per), minlength=len(texts))
    columns = [sizes, chars, symbols, again, repeated(np.concatenate(ids), sizes), content / np.maximum(sizes, 1)]
    return [pa.array(c, t) for c, t in zip(columns, OUT.values(), strict=True)]


def rate(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row for each row of docs: id, the counts in OUT, content_share, base_failed, kept.

    Null and empty texts have no words and fail. content_share: words in lines that the field marks as content, of all words.
    Repeated rows each get a row. Other columns of docs are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    source = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    kinds = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType()}
    schema = T.StructType([docs.schema[id_col], *(T.StructField(k, kinds[t]) for k, t in OUT.items())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):
                to, total = at, 0
                while to < len(texts) and (to == at or total < CHUNK):
                    total += len(texts[to] or b"")
                    to += 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *measure(texts[at:to], sent.value)], names=[id_col, *OUT])
                at = to

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = map_batches(source, batches, schema).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= content_share))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}

"""SentencePiece encoding and decoding: a unigram Viterbi search over a double-array trie, for all distinct words of a batch at once."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import gathered, map_batches, table

#: Where the query's model is, if the session doesn't name another in MODEL_SETTING.
MODEL, MODEL_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.tideline.pieces.model"
#: The white-space marker, U+2581; in the trie it is one byte, the space.
MARK = "▁".encode()
#: What an unknown character costs beyond the least likely piece.
UNKNOWN = 10.0
# Fixed values of the model format: kinds of pieces, and the kind of model whose scores are log probabilities.
NORMAL, USER, BYTE = 1, 4, 6
UNIGRAM = 1
#: Bytes of distinct words that one search holds; if that is fewer than FEW words, they are searched one by one.
CELLS, FEW = 1 << 20, 24
#: Bytes of text whose words are searched together.
TEXTS = 4 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 5:
            value, at = data[at : at + 4], at + 4
        elif tag & 7 == 1:
            value, at = data[at : at + 8], at + 8
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_pieces(model: bytes) -> list[tuple[bytes, float, int]]:
    """(piece, score, kind) in the order of ids, from a serialised model."""
    out = []
    for field, value in _fields(model):
        if field == 1:
            parts = dict(_fields(value))
            out.append((parts.get(1, b""), struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0, parts.get(3, NORMAL)))
    return out


def model_kind(model: bytes) -> int:
    """The kind of a serialised model, as its trainer's settings state it (unigram if they don't)."""
    return next((dict(_fields(value)).get(3, UNIGRAM) for field, value in _fields(model) if field == 2), UNIGRAM)


def rank_scores(pieces: list[tuple[bytes, float, int]]) -> list[float]:
    """Log probabilities by rank, after Zipf and Mandelbrot: for models whose scores are merge ranks and not log probabilities."""
    normal = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
    weights = 1 / (np.arange(len(normal)) + 2.7)
    out = np.zeros(len(pieces))
    out[normal] = np.log(weights / weights.sum())
    return out.tolist()


class Trie:
    """A double array over bytes: child c of state s is base[s] + c if check of that is s; value: the piece that ends there, or -1."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        root: dict = {}
        for key, value in keys.items():
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        base, check, value = {0: 0}, {0: 0}, {0: -1}  # by state
        single = several = 1  # where the search for room begins; what lies before is all but full
        queue = [(root, 0)]
        for node, state in queue:
            value[state] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            if len(codes) == 1:
                while single in check or single <= codes[0]:
                    single += 1
                at = single - codes[0]
            else:
                at, tried = several, 0
                while any(at + c in check for c in codes):
                    at, tried = at + 1, tried + 1
                several = at - 64 if tried > 1024 else several
            base[state] = at
            for c in codes:
                check[at + c] = state
            queue += [(node[c], at + c) for c in codes]
        size = max(max(check), max(base.values())) + 257
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for array, entries in ((self.base, base), (self.check, check), (self.value, value)):
            array[list(entries)] = list(entries.values())


class Codec:
    """Encodes and decodes with the pieces of a model file's bytes, by the model's own scores if these are log probabilities, else by rank."""

    def __init__(self, model: bytes) -> None:
        pieces = read_pieces(model)
        self.scores = np.array([s for _, s, _ in pieces] if model_kind(model) == UNIGRAM else rank_scores(pieces))
        self.spell = [p.replace(MARK, b" ") for p, _, _ in pieces]
        self.byte_id = np.full(256, -1, np.int32)
        keys = {}
        for i, (_, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte = int(self.spell[i][1:-1], 16)
                self.byte_id[byte], self.spell[i] = i, bytes([byte])
            elif kind in (NORMAL, USER):
                keys[self.spell[i]] = i
            else:
                self.spell[i] = b""
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.byte_id] = True
        self.trie = Trie(keys)
        self.unknown = float(min(self.scores[list(keys.values())])) - UNKNOWN
        self.rows = [array("i", x.tobytes()) for x in (self.trie.base, self.trie.check, self.trie.value)] + [array("d", self.scores.tobytes())]
        if any(b" " in k.lstrip(b" ") or b"\n" in k for k in keys):
            raise ValueError("pieces cross words: this codec searches word by word")

    #: No piece goes on past a space after other bytes, nor has a line end: the best path is made of the best paths of these.
    words = re.compile(rb" *[^ \n]+| +|\n").findall

    def search(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after another, and how many each has."""
        counts = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        found: list[np.ndarray] = []
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at) * len(words[order[to]]) < CELLS:
                to += 1
            if to - at < FEW:  # long words: one by one
                to = at + 1
                ids = self._long(words[order[at]])
                n = len(ids)
            else:
                ids, n = self._viterbi([words[i] for i in order[at:to]])
            counts[order[at:to]] = n
            found.append(ids)
            at = to
        ids = np.concatenate(found) if found else np.empty(0, np.int32)
        back = np.array(order, np.int64)
        starts = np.empty(len(words), np.int64)
        starts[back] = np.concatenate(([0], np.cumsum(counts[back])[:-1])) if len(words) else 0
        return ids[spans(starts, counts)], counts

    def _long(self, word: bytes) -> np.ndarray:
        """The same search for one word: a step is a few looks at lists, and what it holds is two arrays over its bytes."""
        base, check, value, scores = self.rows
        size = len(word)
        best = array("d", bytes(8 * (size + 1)))
        start, piece = array("i", [-1]) * (size + 1), array("i", [-1]) * (size + 1)
        for i in range(size):
            first = word[i]
            if first & 0xC0 == 0x80 or (i and start[i] < 0):
                continue
            here, end, state, single = best[i], min(size, i + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)), 0, False
            for k in range(i, size):
                nxt = base[state] + word[k]
                if check[nxt] != state:
                    break
                state = nxt
                if (v := value[state]) >= 0:
                    if start[k + 1] < 0 or here + scores[v] > best[k + 1]:
                        best[k + 1], start[k + 1], piece[k + 1] = here + scores[v], i, v
                    single |= k + 1 == end
            if not single and (start[end] < 0 or here + self.unknown > best[end]):
                best[end], start[end], piece[end] = here + self.unknown, i, -1
        out, at = array("i"), size
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(int(self.byte_id[c]) for c in reversed(word[start[at] : at]))
            at = start[at]
        return np.array(out[::-1], np.int32)

    def _viterbi(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        text = np.zeros((width, n), np.uint8)  # byte positions by words
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), size)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = flat
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        start = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        for i in range(width):
            row = np.flatnonzero((size > i) & ((text[i] & 0xC0) != 0x80) & (best[i] > -np.inf))
            if not len(row):
                continue
            here = best[i, row]
            first = text[i, row]
            end = np.minimum(i + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0), size[row])
            single = np.zeros(len(row), bool)
            left, state, k = np.arange(len(row)), np.zeros(len(row), np.int64), i
            while True:
                nxt = base[state] + text[k, row[left]]
                ok = check[nxt] == state
                left, state = left[ok], nxt[ok]
                if not len(left):
                    break
                k += 1
                ends = (v := value[state]) >= 0
                if ends.any():
                    w, v = left[ends], v[ends]
                    self._reach(best, start, piece, k, row[w], here[w] + scores[v], i, v)
                    single[w[end[w] == k]] = True
                more = size[row[left]] > k
                left, state = left[more], state[more]
                if not len(left):
                    break
            if len(w := np.flatnonzero(~single)):  # no piece for this character: its bytes
                for k in np.unique(end[w]):
                    x = w[end[w] == k]
                    self._reach(best, start, piece, int(k), row[x], here[x] + self.unknown, i, np.full(len(x), -1, np.int32))
        out = np.full((n, width), -1, np.int32)
        at, row = size.copy(), np.arange(n)
        while len(row):
            to, of = start[at, row], piece[at, row]
            out[row[of >= 0], to[of >= 0]] = of[of >= 0]
            for r, a, b in zip(row[of < 0], to[of < 0], at[of < 0], strict=True):
                out[r, a:b] = self.byte_id[text[a:b, r]]
            at, row = to[to > 0], row[to > 0]
        return out[out >= 0], (out >= 0).sum(1)

    @staticmethod
    def _reach(best: np.ndarray, start: np.ndarray, piece: np.ndarray, k: int, row: np.ndarray, score: np.ndarray, i: int, of: np.ndarray) -> None:
        better = score > best[k, row]
        row = row[better]
        best[k, row], start[k, row], piece[k, row] = score[better], i, of[better]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each has. A non-empty text is led by a white-space marker."""
        index: dict[bytes, int] = {}
        per, seq = [], []
        for text in texts:
            words = self.words(b" " + text.replace(MARK, b" ")) if text else []
            per.append(len(words))
            seq += [index.setdefault(w, len(index)) for w in words]
        ids, counts = self.search(list(index))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.empty(0, np.int64)
        at = np.array(seq, np.int64)
        n = counts[at]
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *per])]
        return ids[spans(starts[at], n)], np.diff(ends)

    def decode(self, ids: list[int]) -> bytes:
        text = b"".join(map(self.spell.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(counts) else np.empty(0, np.int64)


def _codec(spark: SparkSession, model: str | None):
    """The model is read where the driver runs and sent along: a vocabulary, whose size doesn't depend on the data."""
    with open(model or spark.conf.get(MODEL_SETTING, MODEL), "rb") as f:
        return spark.sparkContext.broadcast(Codec(f.read()))


def _groups(b: pa.RecordBatch, column: int, limit: int = TEXTS) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < b.num_rows:
        to, total = at, 0
        while to < b.num_rows and (to == at or total < limit):
            total += len(b.column(column)[to].as_buffer()) if b.column(column)[to].is_valid else 0
            to += 1
        yield b.slice(at, to - at)
        at = to


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """(*keep, ids array<int>): null and empty texts have no ids. Every row of docs gives a row."""
    codec = _codec(docs.sparkSession, model)
    source = docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(it, len(keep), TEXTS):
            for b in _groups(batch, len(keep)):
                ids, n = codec.value.encode(b.column(len(keep)).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], names=[*keep, "ids"])

    return map_batches(source, batches, schema)


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """(*keep, text): the text of each list of ids; no ids give an empty text. Bytes that are no UTF-8 become U+FFFD."""
    codec = _codec(encoded.sparkSession, model)
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [codec.value.decode(x).decode("utf-8", "replace") for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return map_batches(encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), batches, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_ids, n_byte_ids, ids_sha256, exact) of every row: exact tells whether decoding the ids gives the text again.

    It does but for texts that hold the marker itself, which comes back as a space. ids_sha256 is over little-endian 32-bit ids.
    Null and empty texts have no ids and are exact. Equal texts have equal values; repeated rows each get a row.
    """
    codec = _codec(docs.sparkSession, model)
    source = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    long = T.LongType()
    names = {"n_ids": long, "n_byte_ids": long, "ids_sha256": T.StringType(), "exact": T.BooleanType()}
    schema = T.StructType([docs.schema[id_col], *(T.StructField(k, v) for k, v in names.items())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(it, 1, TEXTS):
            for b in _groups(batch, 1):
                texts = b.column(1).to_pylist()
                ids, n = codec.value.encode(texts)
                ids, at = ids.astype("<i4"), np.concatenate(([0], np.cumsum(n)))
                bytes_ = np.concatenate(([0], np.cumsum(codec.value.is_byte[ids])))[at]
                parts = [ids[i:j] for i, j in zip(at, at[1:], strict=False)]
                sha = [hashlib.sha256(p).hexdigest() for p in parts]
                exact = [codec.value.decode(p.tolist()) == (t or b"") for p, t in zip(parts, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.diff(bytes_)), pa.array(sha), pa.array(exact)], names=[id_col, *names])

    return map_batches(source, batches, schema)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pieces": op10_pieces}
ORACLE_SQL: dict[str, str] = {}

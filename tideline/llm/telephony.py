"""Media columns: bytes kept as telephony audio, expanded by lookup tables and decoded block by block with numpy."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import map_batches, table

UNIT = 576
RATE = 8000
#: Bytes of an ADPCM block: a header of 4, then two samples a byte.
BLOCK = 72
#: Payload bytes whose samples are in memory at once.
CHUNK = 2 << 20

# Fixed values of IMA ADPCM: step sizes and index changes.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]


def mu_law_table() -> np.ndarray:
    """G.711 mu-law byte -> 16-bit sample."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """G.711 A-law byte -> 16-bit sample."""
    a = np.arange(256) ^ 0x55
    exponent, size = (a >> 4) & 7, ((a & 0x0F) << 4) + 8
    size = np.where(exponent == 0, size, (size + 0x100) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MU_LAW, A_LAW = mu_law_table(), a_law_table()
_index, _nibble = np.divmod(np.arange(89 * 16), 16)
_step = np.array(STEPS)[_index]
_size = (_step >> 3) + np.where(_nibble & 1, _step >> 2, 0) + np.where(_nibble & 2, _step >> 1, 0) + np.where(_nibble & 4, _step, 0)
DIFF = np.where(_nibble & 8, -_size, _size).astype(np.int32)
NEXT = (np.clip(_index + np.array(INDEX)[_nibble & 7], 0, 88) * 16).astype(np.int32)


def decode_adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """IMA ADPCM, mono: bytes of whole blocks -> int16 (blocks, samples). Sample by sample, all blocks at once; an index over 88 is 88."""
    data = data.reshape(-1, block)
    value = data[:, 0].astype(np.int32) | (data[:, 1].astype(np.int32) << 8)
    value = np.where(value > 32767, value - 65536, value)
    index = np.minimum(data[:, 2], 88).astype(np.int32) * 16
    body = np.ascontiguousarray(data[:, 4:].T)
    out = np.empty((1 + 2 * (block - 4), len(data)), np.int16)
    out[0] = value
    for k in range(2 * (block - 4)):
        at = index + ((body[k // 2] >> 4) if k % 2 else (body[k // 2] & 15))
        value = np.clip(value + DIFF[at], -32768, 32767)
        index = NEXT[at]
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + b"\xff" * (max(unit, -(-len(data) // unit) * unit) - len(data))


#: WAVE formats.
A_LAW_FORMAT, MU_LAW_FORMAT, ADPCM_FORMAT = 6, 7, 17


def store(payload: bytes, rate: int = RATE, law: int = MU_LAW_FORMAT) -> bytes:
    """A WAVE file, mono: 8-bit mu-law or A-law samples, or blocks of IMA ADPCM."""
    if law == ADPCM_FORMAT:
        n = 1 + 2 * (BLOCK - 4)
        fmt = struct.pack("<4sIHHIIHHHH", b"fmt ", 20, law, 1, rate, rate * BLOCK // n, BLOCK, 4, 2, n)
        fact = struct.pack("<4sII", b"fact", 4, n * (len(payload) // BLOCK))
    else:
        fmt = struct.pack("<4sIHHIIHHH", b"fmt ", 18, law, 1, rate, rate, 1, 8, 0)
        fact = struct.pack("<4sII", b"fact", 4, len(payload))
    body = b"WAVE" + fmt + fact + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def contents(media: bytes) -> tuple[int, int, bytes]:
    """Format, bytes of a block and payload of such a file; chunks of other kinds are passed over."""
    kind, _, form = struct.unpack_from("<4sI4s", media)
    if (kind, form) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAVE file")
    at, law, block = 12, None, 1
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            law, _, _, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        if name == b"data":
            if law not in (A_LAW_FORMAT, MU_LAW_FORMAT, ADPCM_FORMAT):
                raise ValueError(f"format {law} is none of A-law, mu-law and ADPCM")
            return law, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def load(media: bytes) -> bytes:
    """The payload of such a file."""
    return contents(media)[2]


def samples(media: bytes) -> np.ndarray:
    """The 16-bit samples of such a file, mono, of any of the three formats; a last block of ADPCM may be short."""
    law, block, payload = contents(media)
    data = np.frombuffer(payload, np.uint8)
    if law != ADPCM_FORMAT:
        return (MU_LAW if law == MU_LAW_FORMAT else A_LAW)[data]
    rest = len(data) % block
    cut = block - max(rest, 4) if rest >= 4 else 0  # bytes that a short last block lacks
    data = np.append(data, np.zeros(cut, np.uint8)) if cut else data[: len(data) - rest]
    step = max(CHUNK // block, 1) * block
    out = np.empty(len(data) // block * (1 + 2 * (block - 4)), np.int16)
    at = 0
    for k in range(0, len(data), step):
        part = decode_adpcm(data[k : k + step], block).ravel()
        out[at : at + len(part)] = part
        at += len(part)
    return out[: len(out) - 2 * cut]


def expand(media: bytes) -> np.ndarray:
    """The samples of such a file at twice the rate."""
    s = samples(media)
    out = np.empty(2 * len(s), np.int16)
    for k in range(0, len(s), CHUNK):
        part = s[k : k + CHUNK]
        out[2 * k : 2 * (k + len(part))] = resample(part, np.array([len(part)]), s[k + CHUNK : k + CHUNK + 1])
    return out


def resample(samples: np.ndarray, lengths: np.ndarray, following: np.ndarray | None = None) -> np.ndarray:
    """Twice the rate by linear interpolation; lengths: of the recordings that lie one after another, whose ends aren't mixed.

    following: the first sample of what the last recording goes on with, if it does.
    """
    wide = samples.astype(np.int32)
    after = np.append(wide[1:], 0)
    ends = np.cumsum(lengths) - 1
    after[ends] = wide[ends]
    if following is not None and len(following):
        after[-1] = following[0]
    return np.stack((wide, (wide + after) >> 1), axis=1).astype(np.int16).ravel()


class Levels:
    """Features of a recording from its pieces, in order."""

    def __init__(self) -> None:
        self.peak, self.squares, self.size = [0, 0, 0], [0, 0, 0], [0, 0, 0]
        self.crossings, self.pcm_crc, self.adpcm_crc, self.last = 0, 0, 0, None

    def add(self, pcm: np.ndarray, mu: np.ndarray, a: np.ndarray, adpcm: np.ndarray) -> None:
        """mu-law samples at twice the rate, mu-law and A-law samples, and ADPCM samples."""
        for k, x in enumerate((mu, a, adpcm)):
            self.peak[k] = max(self.peak[k], int(np.abs(x.astype(np.int32)).max()))
            self.squares[k] += int(np.square(x.astype(np.int64)).sum())
            self.size[k] += x.size
        below = mu < 0
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.last is not None and bool(below[0]) != self.last)
        self.last = bool(below[-1])
        self.pcm_crc, self.adpcm_crc = zlib.crc32(pcm, self.pcm_crc), zlib.crc32(adpcm, self.adpcm_crc)

    def feature(self) -> str:
        level = [f"{p}/{int(np.sqrt(q / n))}" for p, q, n in zip(self.peak, self.squares, self.size, strict=True)]
        return f"mu={level[0]};a={level[1]};adpcm={level[2]};zero={self.crossings};adpcm_crc={self.adpcm_crc};pcm_crc={self.pcm_crc}"


def features(payloads: list[bytes]) -> list[str]:
    """Short payloads are decoded together, a long one piece by piece: what is in memory has CHUNK bytes at most."""
    out, at = [], 0
    piece = CHUNK // BLOCK * BLOCK
    while at < len(payloads):
        levels = Levels()
        if len(payloads[at]) > piece:
            data = np.frombuffer(payloads[at], np.uint8)
            for k in range(0, len(data), piece):
                part = data[k : k + piece]
                mu = MU_LAW[part]
                levels.add(resample(mu, np.array([len(mu)]), MU_LAW[data[k + piece : k + piece + 1]]), mu, A_LAW[part], decode_adpcm(part).ravel())
            out.append(levels.feature())
            at += 1
            continue
        to, total = at, 0
        while to < len(payloads) and (to == at or total + len(payloads[to]) <= piece):
            total += len(payloads[to])
            to += 1
        data = np.frombuffer(b"".join(payloads[at:to]), np.uint8)
        lengths = np.array([len(p) for p in payloads[at:to]])
        mu, a, adpcm = MU_LAW[data], A_LAW[data], decode_adpcm(data)
        pcm, start = resample(mu, lengths), 0
        for n in lengths:
            end = start + n
            levels = Levels()
            levels.add(pcm[2 * start : 2 * end], mu[start:end], a[start:end], adpcm[start // BLOCK : end // BLOCK])
            out.append(levels.feature())
            start = end
        at = to
    return out


def telephony(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", law: int = MU_LAW_FORMAT) -> DataFrame:
    """(id, n_bytes, media, pcm): the UTF-8 text padded and stored as a WAVE file of the format `law`, and its samples at twice the rate, 16-bit little-endian.

    Null and empty texts give one unit of padding. Equal texts give equal bytes; repeated rows each get a row.
    """

    def made(texts: list[bytes | None]) -> list[list]:
        media = [store(pad(t or b""), law=law) for t in texts]
        pcm = [expand(m).astype("<i2").tobytes() for m in media]
        return [[len(t or b"") for t in texts], media, pcm]

    return _map(docs, id_col, text_col, [("n_bytes", T.LongType()), ("media", T.BinaryType()), ("pcm", T.BinaryType())], made)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes, digests and features of telephony(), made from the stored bytes read back, without sending the audio on."""

    def made(texts: list[bytes | None]) -> list[list]:
        texts = [t or b"" for t in texts]
        media = [store(pad(t)) for t in texts]
        back = [load(m) for m in media]
        sha = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (back, media)]
        return [[len(t) for t in texts], [len(p) for p in back], sha[0], [zlib.crc32(p[-32:]) for p in back], [len(m) for m in media], sha[1], features(back)]

    long, string = T.LongType(), T.StringType()
    names = [("n_bytes", long), ("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("feature", string)]
    return _map(docs, id_col, text_col, names, made)


def _map(docs: DataFrame, id_col: str, text_col: str, names: list[tuple[str, T.DataType]], made) -> DataFrame:
    source = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in names)])
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    types = [kinds[t] for _, t in names]
    titles = [id_col, *(n for n, _ in names)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = 0
            while at < b.num_rows:  # by rows of some megabytes, since audio is larger than text
                to, total = at, 0
                while to < b.num_rows and (to == at or total < 4 * CHUNK):
                    total += len(b.column(1)[to].as_buffer() or b"") if b.column(1)[to].is_valid else 0
                    to += 1
                part = b.slice(at, to - at)
                columns = made(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=titles)
                at = to

    return map_batches(source, batches, schema)


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op9_telephony": op9_telephony}
ORACLE_SQL: dict[str, str] = {}

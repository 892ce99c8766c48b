"""Near-duplicate detection by the similarity of word shingles: SimHash fingerprints and MinHash bands give candidates, whole shingle sets decide.

Fingerprints of five-word shingles within three bits are found by the generalised pigeonhole index of `simhash`. Of pairs that share 0.8 of
their shingles few lie so near (a fingerprint of 64 bits differs in ten on average), so that bands complete the candidates. Shingles are hashed in Python and numpy per Arrow batch. A text is known by the hash of its shingle set, so that texts of equal sets
are one node. Nothing that grows with the documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import simhash
from tideline.llm.common import components, durable, join_sized, map_batches, text_hash

#: Words of a shingle, and the least share of common shingles (Jaccard) of linked texts.
WORDS, SIMILARITY = 5, 0.8
#: Two texts of similarity s share none of the bands with chance (1 - s ** ROWS) ** BANDS: 5e-6 for 0.8.
ROWS, BANDS = 6, 40
#: Bits in which fingerprints of candidates differ at most.
DISTANCE = 3
#: Shingles that are permuted at once.
CHUNK = 1 << 17
#: Rows of a bucket that are compared in one block; a larger bucket is compared as pairs of blocks.
BLOCK = 512
SEED = 11


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles; the whole text is one if it has fewer words; none without words."""
    import xxhash

    w = text.lower().split() if text else []  # of bytes, as for fingerprints
    if not w:
        return np.empty(0, np.uint64)
    grams = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else [w]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64))


def set_hash(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), 7) if len(s) else 0


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys, of sets that are not empty."""
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 32, (2, BANDS, ROWS), np.uint32)
    a |= np.uint32(1)
    sizes = np.array([len(s) for s in sets])
    flat, starts = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(sets), k + 1, np.uint64)
        for r in range(ROWS):
            key = (key ^ np.minimum.reduceat(flat * a[k, r] + b[k, r], starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, k] = key
    return out


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set of shingles, each of which counts once."""
    sums = np.zeros(simhash.BITS, np.int64)
    for k in range(0, len(s), CHUNK):
        sums += np.unpackbits(s[k : k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(s)).view(">u8")[0])


def signed(docs: DataFrame, names: list[str], words: int) -> DataFrame:
    """(*names, h, n, fp, bands): hash and size of each row's shingle set, its fingerprint and keys; no keys for a text without words."""
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hs, fps, keys = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, BANDS), np.uint64)
            sizes, pending, at, total = np.zeros(b.num_rows, np.int32), [], [], 0
            for i, text in enumerate(b.column(len(names)).to_pylist()):
                if len(s := shingle_set(text, words)):
                    hs[i], fps[i], sizes[i] = set_hash(s), fingerprint(s), len(s)
                    pending.append(s), at.append(i)
                    total += len(s)
                if pending and (total >= CHUNK or i == b.num_rows - 1):
                    keys[at] = bands(pending)
                    pending, at, total = [], [], 0
            n = np.where(hs != 0, BANDS, 0)
            arrays = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(keys[hs != 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(hs.view(np.int64)), pa.array(sizes), pa.array(fps.view(np.int64)), arrays], names=[*names, "h", "n", "fp", "bands"])

    return map_batches(docs.select(*names, F.col("_text").cast("binary").alias("_text")), batches, schema)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(h, set) of rows of (_text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingle_set(t, words) for t in b.column(0).to_pylist()]
            hs = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hs), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["h", "set"])

    return map_batches(texts.select(F.col("_text").cast("binary")), batches, "h long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose sets are similar."""
    n, both = F.size("x") + F.size("y"), F.size(F.array_intersect("x", "y"))
    fits = F.least(F.size("x"), F.size("y")) / F.greatest(F.size("x"), F.size("y")) >= similarity
    found = pairs.join(sets.select(F.col("h").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("h").alias("a"), F.col("set").alias("x")), "a")
    return found.filter(fits).filter(both / (n - both) >= similarity).select("a", "b")


def link_sets(h: np.ndarray, root: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of different roots that connect all similar pairs, as a forest."""
    _, label = np.unique(root, return_inverse=True)
    _, flat = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    mark, out, rows = np.zeros(len(flat) + 1, bool), [], np.arange(len(h))
    for i in range(len(h) - 1):
        fits = np.minimum(sizes, sizes[i]) / np.maximum(sizes, sizes[i]) >= similarity
        if not (fits := fits & (rows > i) & (label != label[i])).any():
            continue
        own = flat[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        both = np.add.reduceat(mark[flat], ends - sizes, dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(fits & (both / (sizes + sizes[i] - both) >= similarity)):
            if label[j] != label[i]:
                out.append((int(h[j]), int(h[i])))
                label[label == label[j]] = label[i]
    return out


def bucket_links(held: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b) from (key, h, root): links of each bucket; one of more than `block` rows is compared as pairs of blocks, each a group of its own."""
    heavy = durable(held.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("h", F.lit(7)), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = join_sized(held, heavy, ["key"], row_bytes=16).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least("own", o), F.greatest("own", o)))
    dealt = dealt.select("h", "root", F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"))
    dealt = dealt.join(sets, "h").select("key", "h", "root", "set").repartition("key").sortWithinPartitions("key", "h")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            key, h, root = (rows.column(c).to_numpy() for c in ("key", "h", "root"))
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            found = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > 1:
                    own = rows.column("set").slice(x, y - x).combine_chunks()
                    found += link_sets(h[x:y], root[x:y], own.flatten().to_numpy(), own.value_lengths().to_numpy().astype(np.int64), similarity)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in it:
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = held.column("key").to_numpy()
            if cut := int(np.searchsorted(key, key[-1])) if len(key) else 0:
                yield out(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield out(held)

    return map_batches(dealt, batches, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, component_id): one row for each row of docs; component_id is the smallest id of the rows that it reaches.

    Rows link when they share at least `similarity` of their shingles. Null, empty and wordless texts are one component. Rows that
    fingerprints link, and each bucket's rows with its first and last, are verified first, which joins most groups at once; only buckets that then
    hold several components are compared row by row, and of buckets with the same rows only one. Large buckets are dealt in pairs of blocks.
    """
    inner = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), text_hash(F.col(text_col)).alias("_t"))
    rows = durable(signed(inner, ["_id", "_t"], words))
    nodes = durable(rows.groupBy("h").agg(F.min("_id").alias("least"), F.min("_t").alias("_t"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    own = F.struct("h", "n")
    fps = durable(nodes.filter("h <> 0").groupBy("fp").agg(F.min(own).alias("first")))
    near = durable(simhash.linked(fps.select("fp"), DISTANCE))
    firsts = near.join(fps.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    firsts = firsts.unionByName(nodes.filter("h <> 0").join(fps, "fp").select(own.alias("x"), F.col("first").alias("y")))
    held = rows.dropDuplicates(["h"]).select("h", "n", F.explode("bands").alias("key"))
    ends = held.groupBy("key").agg(F.count("*").alias("c"), F.min(own).alias("first"), F.max(own).alias("last")).filter("c > 1").drop("c")
    held = durable(held.join(ends, "key"))
    pairs = held.select(own.alias("x"), F.explode(F.array("first", "last")).alias("y")).unionByName(firsts).filter("x.h <> y.h")
    pairs = pairs.filter(F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= similarity)  # sets of other sizes are never so similar
    pairs = durable(pairs.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct())
    asked = held.select("h").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("h"))).distinct()
    want = durable(nodes.join(asked, "h", "left_semi").select("_t"))
    sets = durable(shingle_sets(join_sized(inner, want, ["_t"], "left_semi", 16), words).dropDuplicates(["h"]))
    near = durable(verified(pairs, sets, similarity))
    roots = components(near).select(F.col("node").alias("h"), "root")
    held = held.join(roots, "h", "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    mixed = held.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("all")).filter("x <> y")
    mixed = mixed.groupBy("n", "all").agg(F.min("key").alias("key")).select("key")
    more = bucket_links(durable(held.join(mixed, "key", "left_semi")), sets, similarity)
    roots = components(near.unionByName(more))
    found = nodes.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    label = found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h", "component_id")
    return rows.join(label, "h").select(F.col("_id").alias(id_col), "component_id")

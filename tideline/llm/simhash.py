"""Near-duplicate detection: SimHash fingerprints linked by a generalised pigeonhole index.

Words are hashed in Python and numpy per Arrow batch; links are found per bucket with numpy; grouping, joins and connected
components are DataFrame operations. Nothing that grows with the documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import components, durable, join_sized, map_batches, table

BITS = 64
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 17
#: Fingerprints on which the bit groups and thresholds are fitted; the index itself holds every fingerprint.
SAMPLE = 2048
#: Rows of a bucket that are compared in one block. A larger bucket is split by further bits; one that stays large is compared as pairs of blocks.
BLOCK = 2048


def _bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprint_texts(texts: list[bytes | None], words: int = 3) -> np.ndarray:
    """uint64 fingerprints of UTF-8 texts; zero where there is no word."""
    import xxhash

    digest, join = xxhash.xxh64_intdigest, b" ".join
    out = np.zeros(len(texts), np.uint64)
    rows: list[int] = []
    counts: list[int] = []
    pending: list[int] = []

    def pack(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.packbits((2 * sums > n[:, None]).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)

    def flush() -> None:
        if rows:
            n = np.array(counts, np.int64)
            out[rows] = pack(_bit_sums(np.array(pending, np.uint64), np.concatenate(([0], np.cumsum(n)[:-1]))), n)
        rows.clear(), counts.clear(), pending.clear()

    for i, text in enumerate(texts):
        w = text.lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
        if not w:
            continue
        shingles = map(join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [join(w)]
        hashes = [digest(s, 42) for s in shingles]
        if len(hashes) > CHUNK:  # a very long text is summed piece by piece
            sums = sum(_bit_sums(np.array(hashes[k : k + CHUNK], np.uint64), np.array([0])) for k in range(0, len(hashes), CHUNK))
            out[i] = pack(sums, np.array([len(hashes)]))[0]
            continue
        rows.append(i)
        counts.append(len(hashes))
        pending += hashes
        if len(pending) >= CHUNK:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp): the fingerprint of each row as a signed long; null or wordless texts have 0."""
    names = [id_col, *keep]
    source = docs.select(*names, F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("fp", T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = fingerprint_texts(b.column(len(names)).to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fp)], names=[*names, "fp"])

    return map_batches(source, batches, schema)


# --- the plan of the index ---------------------------------------------------


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bit positions (0: least significant) in `parts` groups of even width, correlated bits together."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        group = [left.pop(int(np.argmax(corr[np.ix_(left, left)].sum(1))))]
        while len(group) < (BITS * (k + 1)) // parts - (BITS * k) // parts:
            group.append(left.pop(int(np.argmax(corr[np.ix_(left, group)].mean(1)))))
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost: costs[i][t + 1] is the cost of threshold t (-1: unused) in group i; they sum to `total`."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                if (at := used + t) not in step or cost + c < step[at][0]:
                    step[at] = (cost + c, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan_index(sample: np.ndarray, n: int, distance: int) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, bits) of the groups to probe, for n fingerprints.

    By the general pigeonhole principle, two fingerprints within `distance` agree to threshold t_i in some of m groups if the
    thresholds sum to distance - m + 1. The cost of a threshold is what it probes plus the pairs it is estimated to compare.
    Distance 0 links nothing but equal fingerprints and needs no groups.
    """
    if len(sample) < 2:
        sample = np.array([0, 1], np.uint64)
    i, j = np.triu_indices(len(sample), 1)
    xor = sample[i] ^ sample[j]
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, distance + 2):
        groups, costs = group_bits(sample, m), []
        for g in groups:
            d = np.bitwise_count(xor & np.uint64(_mask(g)))
            row = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(g), k) for k in range(t + 1))
                chance = max(float((d <= t).mean()), probes / 2.0 ** len(g))
                row.append(60.0 * n * probes + n * n / 2 * chance)
            costs.append(row)
        cost, chosen = allocate(costs, distance - m + 1)
        if cost < best[0]:
            best = (cost, [(_mask(g), t, g) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(near: Column, at: Column, k: int) -> Column:
    return F.transform(near, lambda x: F.xxhash64(F.lit(k), at.bitwiseXOR(x)))


def signatures(fps: DataFrame, plan: list[tuple[int, int, list[int]]]) -> DataFrame:
    """(key, fp): every bucket in which a fingerprint of fps stands or looks."""
    arrays = []
    for k, (mask, t, bits) in enumerate(plan):
        flips = [0, *(_mask(list(c)) for r in range(1, t + 1) for c in combinations(bits, r))]
        near = F.array(*(F.lit(_signed(x)).cast("long") for x in flips))
        at = F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long"))
        arrays.append(_keys(near, at, k))
    return fps.select("fp", F.explode(F.concat(*arrays)).alias("key"))


def link_buckets(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key -> (member, root): the links inside each bucket as a forest, at most one row a member."""
    n = len(key)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    label, at, s = np.arange(n), np.arange(n), 1
    fp = fp.view(np.uint64)
    while len(at := at[at + s < ends[at]]):
        a = at[np.bitwise_count(fp[at] ^ fp[at + s]) <= distance]
        while len(a := a[label[a] != label[a + s]]):
            x, y = label[a], label[a + s]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while ((up := label[label]) != label).any():
                label = up
        s += 1
    member = np.flatnonzero(label != np.arange(n))
    return fp[member].view(np.int64), fp[label[member]].view(np.int64)


def further_masks(plan: list[tuple[int, int, list[int]]], distance: int) -> list[int]:
    """distance + 1 masks that share out all bits, each with bits of every group: two fingerprints within `distance` agree on one of them whole."""
    bits = [b for _, _, group in plan for b in group]
    bits += [b for b in range(BITS) if b not in bits]
    return [_mask(bits[k :: distance + 1]) for k in range(distance + 1)]


def large(held: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of the buckets with more than `block` rows."""
    return durable(held.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))


def links(fps: DataFrame, plan: list[tuple[int, int, list[int]]], distance: int, block: int = BLOCK) -> DataFrame:
    """(a, b): for distinct fingerprints, links that connect all pairs within `distance`; a bucket gives a forest, never all its pairs.

    The rows of a bucket of more than `block` are dealt to smaller ones: one for each of distance + 1 shares of all bits, on one of which two
    linked rows agree. What is still larger (fingerprints that differ in a few bits only) is compared as pairs of blocks, each of them a group of
    its own, so that no task depends on the size of a bucket.
    """
    if not plan:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    sig = signatures(fps, plan)
    first = large(sig, block).withColumnRenamed("blocks", "split")
    again = F.array(*(F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long"))) for k, mask in enumerate(further_masks(plan, distance))))
    sig = join_sized(sig, first, ["key"], row_bytes=16).select("fp", F.explode(F.when(F.col("split").isNull(), F.array("key")).otherwise(again)).alias("key"))
    heavy = large(sig, block)
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = join_sized(sig, heavy, ["key"], row_bytes=16).withColumn("own", own)
    dealt = dealt.select(
        "fp",
        F.explode(
            F.when(F.col("blocks").isNull(), F.array(F.col("key"))).otherwise(
                F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least("own", o), F.greatest("own", o)))
            )
        ).alias("key"),
    )
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps_ = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = link_buckets(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for rows in it:
            keys = np.concatenate((keys, rows.column("key").to_numpy()))
            fps_ = np.concatenate((fps_, rows.column("fp").to_numpy()))
            if len(keys) > 1 << 18 and (cut := int(np.searchsorted(keys, keys[-1]))):
                yield out(keys[:cut], fps_[:cut])
                keys, fps_ = keys[cut:], fps_[cut:]
        if len(keys):
            yield out(keys, fps_)

    return map_batches(dealt.select("key", "fp"), batches, "a long, b long").filter("a <> b")


def linked(fps: DataFrame, distance: int) -> DataFrame:
    """links() of a durable table of distinct fingerprints, with the plan fitted on a sample of them."""
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    return links(fps, plan_index(sample, fps.count(), distance), distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp, component_id): one row for each row of docs; component_id is the smallest id of the rows that it reaches.

    Rows link when their fingerprints differ in at most `distance` bits. Null, empty and wordless texts share fingerprint 0.
    Rows with a null id take part; a component of null ids only has a null component_id. Repeated rows each get a row.
    An empty table gives an empty result; other columns of docs, whatever their names, are not looked at.
    """
    names = [id_col, *keep]
    inner = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    rows = durable(fingerprints(inner, "_id", "_text", words, tuple(f"_keep_{i}" for i in range(len(keep)))))
    fps = durable(rows.groupBy("fp").agg(F.min("_id").alias("least")))
    roots = components(linked(fps.select("fp"), distance))
    nodes = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    label = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    out = rows.join(label, "fp")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}

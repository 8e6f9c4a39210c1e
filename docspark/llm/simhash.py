"""SimHash near-duplicate detection with bit-sliced comparison.

Documents with equal fingerprints collapse to one row first. Fingerprints within the radius agree in two of
five bit ranges, so each is put in ten buckets, one for each pair of ranges, and compared inside them only.
A bucket with more than ``HOT`` fingerprints is split on four ranges of its other bits, of which again one
must agree, and so on, until it is small or 12 bits are left, which no more than 4,096 fingerprints tell apart. So no bucket
grows with the data, and no pair within the radius is lost.

Inside a task the buckets lie one after another, as 64 vertical bit planes. All lanes are compared with the
lane d places on at once: the planes are XORed with themselves shifted by d, distances are kept in carry-save
bitwise counters, and words in which every lane has exceeded the radius are abandoned. Only a spanning forest
of the links found leaves the task, never all pairs.

With a ``similarity``, texts whose sets of shingles have at least that Jaccard similarity are linked as well, at any
distance of their fingerprints: at 0.8 these differ in about ten bits and up to twenty, which no index of 64 bits can
serve. So candidates are texts that share one of 40 bands of five min-hashes, which two texts of similarity 0.8 miss
with a probability of 1.2e-7 (0.95: below 1e-25); joined bands make groups of distinct texts, in which all pairs are
compared exactly. A large group is dealt to parts of about ``GROUP`` texts or ``GROUP_BYTES``, and every two parts meet in a task
of their own, in bounded memory; all the work together grows with the square of the group.

Defined results: null text counts as empty, with fingerprint zero, and is linked like any other; a null id
takes part, but never names a component unless it has no other id; repeated rows are kept; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import hand_back, join_counted, materialise, sieve, sift, table
from docspark.llm.components import connected_components

RADIUS, WIDTH, SEED, HOT = 3, 3, 42, 4096
#: Of the verified links: shingle width, least similarity, bands and min-hashes in each.
NEAR_WIDTH, NEAR, BANDS, ROWS, GROUP, GROUP_BYTES = 5, 0.8, 40, 5, 1024, 4 << 20
RANGES = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
PAIRS = tuple(combinations(range(5), 2))


def simhash(data: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned fingerprint of a UTF-8 text: bits set in over half of its shingles' hashes."""
    from functools import partial

    import xxhash

    words = data.lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) < width:
        return digest(b" ".join(words))
    ones, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for start in range(0, n, 65_536):
        part = words[start : start + 65_536 + width - 1]
        count = min(65_536, n - start)
        shingles = map(b" ".join, zip(*(part[k : k + count] for k in range(width)), strict=True))
        hashes = np.fromiter(map(digest, shingles), dtype="<u8", count=count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """The fingerprint of each text as a signed long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([simhash(x.as_py() or b"", width, seed) for x in batch.cast(pa.binary())], dtype=np.uint64)
            yield pa.array(found.view(np.int64))

    return run(text)


def _shifted(plane: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """At the given words of a bit plane, the bits d lanes on. The plane ends with enough empty words."""
    over, r = divmod(d, 64)
    low = plane[words + over]
    return low if not r else (low >> np.uint64(r)) | (plane[words + (over + 1)] << np.uint64(64 - r))


def _within(planes: np.ndarray, mask: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Lanes i, of those in mask, whose fingerprint is within the radius of lane i + d's."""
    words = np.flatnonzero(mask)
    mask = mask[words]
    counters = [np.zeros(len(words), dtype=np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(words), dtype=np.uint64)
    for b in range(0, 64, 2):
        x, y = (planes[k][words] ^ _shifted(planes[k], words, d) for k in (b, b + 1))
        # a full adder takes two planes into the lowest counter; its carry goes up one by one
        both = counters[0] ^ x
        carry = (counters[0] & x) | (both & y)
        counters[0] = both ^ y
        for k in range(1, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 6:
            alive = np.flatnonzero(mask & ~over)
            if len(alive) < len(words):  # abandon words in which every lane has exceeded the radius
                words, mask, over = words[alive], mask[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(words):
                    return words
    good = np.unpackbits((mask & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    if radius & (radius + 1):
        total = sum(np.unpackbits(c.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int) << k for k, c in enumerate(counters))
        good &= total <= radius
    at, lane = np.nonzero(good)
    return words[at] * 64 + lane


def spanning_links(prints: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(lane, lane) links that join all lanes of a bucket which links within the radius join.

    ``prints`` are unsigned fingerprints, ``bucket`` numbers that don't fall. Lanes of buckets of about the
    same size are compared together.
    """
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.array([], dtype=int)
    sizes = np.diff(np.r_[starts, len(bucket)])
    left, right = [], []
    root = np.arange(len(bucket))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    least = 2
    while len(sizes) and least <= sizes.max():
        chosen = np.flatnonzero((sizes >= least) & (sizes < 2 * least))
        least *= 2
        if not len(chosen):
            continue
        n = int(sizes[chosen].sum())
        local = np.arange(n) - np.repeat(np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen])
        lanes = np.repeat(starts[chosen], sizes[chosen]) + local
        own, rest = prints[lanes], np.repeat(sizes[chosen], sizes[chosen]) - local
        spare = -n % 64 + 64 * (2 * least // 64 + 2)
        planes = np.empty((64, (n + spare) // 64), dtype=np.uint64)
        for b in range(64):
            planes[b] = np.packbits(np.pad((own >> np.uint64(b)).astype(np.uint8) & 1, (0, spare)), bitorder="little").view(np.uint64)
        for d in range(1, int(sizes[chosen].max())):
            mask = np.packbits(np.pad(rest > d, (0, spare)), bitorder="little").view(np.uint64)
            found = _within(planes, mask, d, radius)
            if len(found):
                a, b = lanes[found], lanes[found + d]
                new = root[a] != root[b]
                for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True):
                    if (p := find(i)) != (q := find(j)):
                        root[max(p, q)] = min(p, q)
                        left.append(i)
                        right.append(j)
                while not np.array_equal(root[lanes], deeper := root[root[lanes]]):
                    root[lanes] = deeper
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (mask, value, fp) rows. A bucket that goes on in the next batch is kept for it."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        change = np.r_[False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        a, b = spanning_links(rows[:, 2].view(np.uint64), np.cumsum(change))
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 2]), pa.array(rows[b, 2])], ["a", "b"])

    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
        if not len(rows):
            continue
        new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        held_goes_on = held and (held[-1][-1, :2] == rows[0, :2]).all()
        cut = int(new[-1]) if len(new) else 0
        if held and not held_goes_on:
            yield links(np.concatenate(held))
            held = []
        if cut:
            yield links(np.concatenate([*held, rows[:cut]]))
            held = []
        held.append(np.ascontiguousarray(rows[cut:]))
    if held:
        yield links(np.concatenate(held))


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def finer(mask: int) -> list[int]:
    """The four masks of a bucket's parts: the bits that agree, and one of four ranges of the others."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [_signed(mask % (1 << 64) | sum(1 << b for b in rest[len(rest) * j // 4 : len(rest) * (j + 1) // 4])) for j in range(4)]


def near_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that join all fingerprints (column fp, distinct) which links of radius 3 or less join."""
    spark, parts = prints.sparkSession, []
    masks = [_signed(sum(1 << b for k in pair for b in range(*RANGES[k]))) for pair in PAIRS]
    rows = prints.select(F.explode(F.array(*map(F.lit, masks))).alias("mask"), "fp")
    while True:
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        full = rows.where(F.bit_count("mask") < 52).groupBy("mask", "value").count().where(F.col("count") > hot)
        crowded = materialise(full.select("mask", "value"), "crowded")
        split = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # at most ten, four times as many each round
        if not split:
            parts.append(rows)
            break
        parts.append(rows.join(crowded, ["mask", "value"], "left_anti"))
        next_masks = spark.createDataFrame([(m, finer(m)) for m in split], "mask long, finer array<long>")
        rows = rows.join(crowded, ["mask", "value"], "left_semi").join(F.broadcast(next_masks), "mask").select(F.explode("finer").alias("mask"), "fp")
    dealt = reduce(DataFrame.unionByName, parts).repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.mapInArrow(_spans, "a long, b long")


def shingle_set(data: bytes, width: int = NEAR_WIDTH, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles; of a shorter text one, of one without words none."""
    from functools import partial

    import xxhash

    words = data.lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter(map(digest, map(b" ".join, zip(*(words[k : k + n] for k in range(min(width, len(words)))), strict=True))), dtype=np.uint64, count=n))


def band_keys(text: Column, width: int = NEAR_WIDTH) -> Column:
    """The keys of a text's bands, none for a text without words."""
    rng = np.random.default_rng(SEED)
    factor, plus = (rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
    factor, mix = factor | np.uint64(1), rng.integers(0, 2**64, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)

    def keys(data: bytes) -> list[int] | np.ndarray:
        shingles = shingle_set(data, width)
        if not len(shingles):
            return []
        least = np.min([(shingles[k : k + 1024] * factor + plus).min(axis=1) for k in range(0, len(shingles), 1024)], axis=0)
        least ^= least >> np.uint64(32)
        return ((least.reshape(BANDS, ROWS) * mix[:, :ROWS]).sum(axis=1, dtype=np.uint64) + mix[:, ROWS]).view(np.int64)

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([keys(x.as_py() or b"") for x in batch.cast(pa.binary())], pa.list_(pa.int64()))

    return run(text)


def verified_links(texts: list[bytes], similarity: float = NEAR, width: int = NEAR_WIDTH) -> list[tuple[int, int]]:
    """Links (i, j), j < i, that join all texts which pairs of at least this Jaccard similarity join; all pairs are counted exactly."""
    sets = [shingle_set(x, width) for x in texts]
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate([*sets, np.array([], dtype=np.uint64)]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    posted, starts = owner[order], np.r_[0, np.cumsum(np.bincount(ids))]
    at = np.empty(len(ids), dtype=np.int64)
    at[order] = np.arange(len(ids))  # where each shingle of each text lies among its postings
    ends = np.r_[0, np.cumsum(sizes)]
    root, links = np.arange(len(sets)), []
    for i in range(1, len(sets)):
        mine = slice(ends[i], ends[i + 1])
        before = [posted[a:b] for a, b in zip(starts[ids[mine]].tolist(), at[mine].tolist(), strict=True) if a < b]
        if not before:
            continue
        common = np.bincount(np.concatenate(before), minlength=i)
        for j in np.flatnonzero((common > 0) & (common >= similarity * (sizes[i] + sizes[:i] - common))).tolist():
            if root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                links.append((i, j))
    return links


def similar_links(docs: DataFrame, similarity: float = NEAR, width: int = NEAR_WIDTH, prints_width: int = WIDTH) -> DataFrame:
    """Links (a, b) of fingerprints (of ``prints_width`` words) that join all texts of at least this similarity; ``docs`` has text."""
    rows = docs.select(F.xxhash64("text").alias("id"), "text")
    banded = materialise(rows.select("id", band_keys(F.col("text"), width).alias("keys")), "bands")
    keyed = banded.dropDuplicates(["id"]).select("id", F.explode("keys").alias("key"))
    # a band's texts hang under the least of them; a band that very many share is joined by broadcast
    first = materialise(keyed.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1"), "shared")
    met = join_counted(sift(keyed, "key", sieve(first, "key")), first, ["key"], first.agg(F.sum("n")).first()[0] or 0)
    groups = connected_components(met.select(F.col("id").alias("a"), "b")).select(F.col("node").alias("id"), "root")
    copies = materialise(banded.groupBy("id").agg(F.count("*").alias("n")).join(groups, "id"), "groups")
    grouped = sift(rows, "id", sieve(copies, "id"))  # so that no other texts are dealt
    members = join_counted(grouped, copies, ["id"], banded.count()).groupBy("id").agg(F.first("root").alias("root"), F.first("text").alias("text"))
    members = materialise(members, "members")
    parts = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum(F.octet_length("text")) / GROUP_BYTES)).cast("int")
    sized = members.join(members.groupBy("root").agg(parts.alias("parts")), "root")
    placed = sized.withColumn("part", F.pmod("id", F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = placed.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "text")

    def links(group: pa.Table) -> pa.Table:
        texts = group["text"].cast(pa.binary()).to_pylist()
        found = verified_links(texts, similarity, width)
        fp = {i: simhash(texts[i], prints_width) for i in {x for link in found for x in link}}
        ends = [np.array([fp[link[k]] for link in found], dtype=np.uint64).view(np.int64) for k in (0, 1)]
        if len(texts) > GROUP // 2:
            hand_back()
        return pa.table({"a": ends[0], "b": ends[1]})

    return met.groupBy("root", "low", "high").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, hot: int = HOT, similarity: float | None = None) -> DataFrame:
    """For each row its key, ``fp`` (signed long) and ``component``, the smallest key that links reach.

    Links are those of the fingerprints and, with a ``similarity``, also all pairs of at least that Jaccard similarity of
    sets of ``NEAR_WIDTH`` words.
    """
    prints = materialise(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), width).alias("fp")), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "distinct")
    links = near_links(distinct.select("fp"), hot)
    if similarity is not None:
        links = links.union(similar_links(docs.select(F.col(text).alias("text")).where("text is not null"), similarity, prints_width=width))
    nodes = connected_components(links)
    linked = distinct.join(nodes, distinct.fp == nodes.node).select("fp", "least", "root")
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_linked = linked.join(named, "root").select("fp", "component")
    of_all = materialise(distinct.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component")), "components")
    total = of_all.agg(F.sum("n")).first()[0] or 0
    return join_counted(prints, of_all, ["fp"], total).select(F.col("key").alias(key), "fp", "component")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

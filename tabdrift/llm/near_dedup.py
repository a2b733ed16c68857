"""Near-duplicate classes by a multi-index Hamming join of b-bit MinHash signatures.

Documents are sets of word shingles. Each distinct set gets a signature of
``hashes`` symbols of 16 bits. Two sets of similarity J differ in a symbol with
probability 1 - J at most, so their Hamming distance in symbols stays within
``distance`` except with probability ``miss``. All pairs within that distance are
guaranteed to meet: the symbols are cut into chunks, by pigeonhole some chunk of a
pair within the distance has at most ``errors`` differing symbols, and every way
to leave out that many symbols of a chunk is a key.

Not all pairs of a bucket are formed. First each member meets the bucket's hub, the
member that shares most buckets; the confirmed links give components. Buckets that lie in one
component are done. In the others members of different components meet directly if
the bucket is small; the members of large ones meet by the rarest shingles of
their sets, where a pair of the wanted similarity must agree (prefix and position
filter), which loses no link. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

from tabdrift.llm.common import carried, in_blocks, mixed, released, small_batches, small_side, written

#: Buckets of at most so many classes are paired directly.
SMALL_BUCKET = 32
#: Most document names that are broadcast to the texts; with more, the texts are joined by shuffle.
BROADCAST_IDS = 400_000
#: Shingles whose frequency the order of the crowd's sets knows; all others count as rare.
COMMON = 200_000
#: Shingles hashed at a time in a task, and words whose hashes a task remembers.
BLOCK, REMEMBERED = 200_000, 100_000


@dataclass(frozen=True)
class NearDupSpec:
    """Shingle length, least similarity in per cent, and the signature's shape."""

    words: int = 5
    percent: int = 80
    hashes: int = 64
    errors: int = 1
    miss: float = 1e-6

    @property
    def distance(self) -> int:
        """Least d with P(Binomial(hashes, 1 - percent/100) > d) <= miss."""
        p, n = 1 - self.percent / 100, self.hashes
        tail, d = 1.0, -1
        while tail > self.miss:
            d += 1
            tail -= comb(n, d) * p**d * (1 - p) ** (n - d)
        return d

    @property
    def chunks(self) -> list[range]:
        """Near-equal runs of symbols, enough that one has at most ``errors`` of ``distance``."""
        m = self.distance // (self.errors + 1) + 1
        cut = [round(i * self.hashes / m) for i in range(m + 1)]
        return [range(a, b) for a, b in zip(cut, cut[1:], strict=False)]

    def linked(self, shared: Column, a: Column, b: Column) -> Column:
        return shared * 100 >= (a + b - shared) * self.percent


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, n: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a whole text in UTF-8.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text with fewer words
    is one shingle, one without words is empty.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out) + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(out))


def _signer(hashes: int):
    seeds = np.random.Generator(np.random.PCG64(20240101)).integers(1, 2**63, (2, hashes), dtype=np.uint64) | np.uint64(1)

    def signatures(sets: list[np.ndarray]) -> np.ndarray:
        flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.empty((len(sets), hashes), np.uint16)
        for k in range(hashes):
            x = flat * seeds[0, k]
            x ^= x >> np.uint64(29)
            x *= seeds[1, k]
            x ^= x >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(x, starts) & np.uint64(0xFFFF)
        return out

    return signatures


def text_hash(text: Column) -> Column:
    """16-byte hash of a text; with the key it names a row, however often the key occurs."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signed(docs: DataFrame, spec: NearDupSpec, text: str, key: str) -> DataFrame:
    """id, text_hash, n, set_hash (16 bytes) and sig of each document; the last two null for empty sets."""

    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signatures = _WordHashes(), _signer(spec.hashes)
        for batch in batches:
            made = (shingle_set(t.as_py(), spec.words, known) for t in batch.column("text").cast(pa.binary()))
            for first, sets in in_blocks(made, len, BLOCK):
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full)) if full else iter(())
                columns = [
                    batch.column("id").slice(first, len(sets)),
                    batch.column("text_hash").slice(first, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "n", "set_hash", "sig"])

    return _texts(docs, text, key).mapInArrow(sign, "id bigint, text_hash binary, n bigint, set_hash binary, sig binary")


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))


def shingle_sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, spec: NearDupSpec, text: str, key: str) -> DataFrame:
    """One row per class named in ``cids`` (cid): cid and its full set, made from its text again."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = _WordHashes(), set()

        def fresh(cid: int) -> bool:
            if cid in made:
                return False
            if len(made) >= REMEMBERED:
                made.clear()
            made.add(cid)
            return True

        for batch in batches:
            batch = batch.filter(pa.array([fresh(c) for c in batch.column("cid").to_pylist()], pa.bool_()))
            sets = (shingle_set(t.as_py(), spec.words, known).view(np.int64) for t in batch.column("text").cast(pa.binary()))
            for first, run in in_blocks(sets, len, BLOCK):
                ends = pa.array(np.cumsum([0, *map(len, run)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(run)))
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(first, len(run)), lists], names=["cid", "shingles"])

    wanted = written(classes.join(cids.select("cid").distinct(), "cid", "left_semi").select("id", "text_hash", "cid"), "nd-wanted")
    rows = _texts(docs, text, key).join(small_side(wanted, BROADCAST_IDS), ["id", "text_hash"]).select("cid", "text")
    sets = written(rows.mapInArrow(make, "cid bigint, shingles array<bigint>"), "nd-sets")
    if sets.count() > wanted.count():
        sets = written(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")), "nd-sets")
    return sets


def chunk_keys(sig: Column, spec: NearDupSpec) -> Column:
    """Array of the keys of a signature: each chunk with each choice of ``errors`` symbols left out."""
    keys = []
    for chunk in spec.chunks:
        for left_out in combinations(chunk, min(spec.errors, len(chunk) - 1)):
            parts = [F.substring(sig, 2 * s + 1, 2) for s in chunk if s not in left_out]
            keys.append(F.xxhash64(F.lit(len(keys)), *parts))
    return F.array(*keys)


@arrow_udf(IntegerType())
def symbol_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of differing 16-bit symbols of two signatures."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(len(s), -1) for s in (a, b))
    return pa.array((x != y).sum(axis=1) if len(a) else [], pa.int32())


def close_pairs(pairs: DataFrame, classes: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Of ``pairs`` (a, b) those within the signature distance."""
    sig = classes.select("cid", "sig")
    both = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b"
    )
    return written(both.filter(symbol_distance("sa", "sb") <= spec.distance).select("a", "b"), "nd-close")


def confirmed(pairs: DataFrame, sets: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets have the wanted similarity."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("xb"))
    shared = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(left, "a").join(right, "b").filter(spec.linked(shared, F.size("xa"), F.size("xb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable vertex of every vertex of ``links`` (a, b): columns cid, root.

    Large-star and small-star rounds: every vertex hands its larger, then its
    smaller neighbours to the smallest one it knows. Minima are partial sums, hot
    vertices meet in plain joins, and each round is a written table; the driver
    sees one checksum a round.
    """
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    stamp = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    last = stamp(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = stamp(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct()
    )


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``COMMON`` most frequent shingles of ``sets``, in order, and how often tasks saw them.

    Tasks count whole sets and report what they saw twice or more. The counts only
    set an order in which rare shingles stand first; any order finds all pairs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = np.unique(np.concatenate([np.empty(0, np.int64), *_arrays(batch.column("shingles"))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[n > 1], pa.int64()), pa.array(n[n > 1], pa.int64())], names=["token", "n"])

    seen = sets.select("shingles").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "token").limit(COMMON).toArrow().sort_by("token")
    return top["token"].to_numpy(), top["n"].to_numpy()


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    """The rows of a list column, without a copy of their values."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def crowd_pairs(crowd: DataFrame, sets: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Pairs (a, b) of ``crowd`` (cid, root) that can have the wanted similarity and differ in root.

    In any fixed order of shingles two such sets x (the larger) and y agree in a
    shingle among the first |x| - ceil(t |x|) + 1 of x and the first
    |y| - ceil(2t / (1 + t) |y|) + 1 of y, and the places of the first one they share
    leave room for the overlap that t asks for. The order puts common shingles last.
    Of a set's hashes modulo 1024, the parities are one bitmap; two bitmaps differ in no
    more bits than the sets in members, which ends most pairs that come near but fall short.
    """
    t, bits = spec.percent, [f"b{i}" for i in range(16)]
    held = written(crowd.join(sets, "cid").select("cid", "root", "shingles"), "nd-crowd")
    common, often = common_shingles(held)

    def prefix_of(x: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """The tokens that stand first in a set, how many of them a smaller set needs, and the bitmap."""
        n, rank = len(x), np.zeros(len(x), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, x), len(common) - 1)
            rank = np.where(common[at] == x, often[at], 0)
        deep, early = n - -(-n * t // 100) + 1, n - -(-n * 2 * t // (100 + t)) + 1
        odd = np.bincount(x & 1023, minlength=1024).astype(np.uint8) & 1
        return x[np.lexsort((x, rank))[:deep]], early, np.packbits(odd).view(np.int64)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _arrays(batch.column("shingles"))
            sizes = np.array([len(x) for x in sets], np.int64)
            for first, run in in_blocks(map(prefix_of, sets), lambda p: len(p[0]), BLOCK):
                here = slice(first, first + len(run))
                long = np.array([len(p[0]) for p in run])
                at = np.concatenate([np.arange(k) for k in long])
                spread = [np.repeat(batch.column(c).to_numpy()[here], long) for c in ("cid", "root")]
                maps = np.stack([p[2] for p in run])
                columns = [
                    np.concatenate([p[0] for p in run]), *spread, np.repeat(sizes[here], long), at,
                    at < np.repeat([p[1] for p in run], long), *(np.repeat(maps[:, i], long) for i in range(len(bits))),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "cid", "root", "n", "at", "early", *bits])

    schema = "token bigint, cid bigint, root bigint, n bigint, at bigint, early boolean, " + ", ".join(f"{b} bigint" for b in bits)
    prefix = written(held.mapInArrow(prefixes, schema), "nd-prefix")
    useful = prefix.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("early").alias("e")).filter("r0 != r1 AND e").select("token")
    rows = prefix.join(useful, "token", "left_semi")
    x = rows.select("token", *(F.col(c).alias(f"x_{c}") for c in ("cid", "root", "n", "at", *bits)))
    y = rows.filter("early").select("token", *(F.col(c).alias(f"y_{c}") for c in ("cid", "root", "n", "at", *bits)))
    unlike = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in bits), F.lit(0))
    fits = (
        (F.col("x_root") != F.col("y_root"))
        & (F.col("y_n") <= F.col("x_n"))
        & (F.col("y_n") * 100 >= F.col("x_n") * t)
        & (F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) * (100 + t) >= (F.col("x_n") + F.col("y_n")) * t)
        & (unlike * (100 + t) <= (F.col("x_n") + F.col("y_n")) * (100 - t))
    )
    met = x.join(y, (x["token"] == y["token"]) & fits)
    return met.select(F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b")).distinct()


def hub_pairs(shared: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's hub (hub, cid). Input: key, cid, members.

    The hub is the member whose buckets hold most members in all, the smallest on ties:
    in a cloud of near copies that is the text they were made from, whatever its id.
    """
    weight = shared.groupBy("cid").agg(F.sum("members").alias("weight"))
    rows = shared.select("key", "cid").join(weight, "cid")
    hubs = rows.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("cid")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("hub"))
    return rows.select("key", "cid").join(hubs, "key").filter("cid != hub").select("hub", "cid")


def _decided(docs: DataFrame, spec: NearDupSpec, text: str, key: str) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n, root, kept, as ``near_classes`` tells.

    A vertex is a distinct set, numbered when it is written; its text is that of its
    smallest key. Keys come in again once the components are known.
    """
    marks = written(signed(docs, spec, text, key), "nd-marks")
    full = marks.filter("set_hash IS NOT NULL AND id IS NOT NULL")
    classes = full.groupBy("set_hash").agg(F.min_by(F.struct("id", "text_hash", "sig"), F.struct("id", "text_hash")).alias("s"))
    classes = classes.select("set_hash", "s.*").withColumn("cid", F.monotonically_increasing_id())
    classes = written(classes, "nd-classes")

    keys = classes.select("cid", F.explode(chunk_keys(F.col("sig"), spec)).alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(keys.join(buckets, "key"), "nd-shared")

    star = hub_pairs(shared).select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct()
    star = close_pairs(star, classes, spec)
    ends = lambda p: p.select(F.col("a").alias("cid")).unionByName(p.select(F.col("b").alias("cid")))
    links = written(confirmed(star, shingle_sets(docs, classes, ends(star), spec, text, key), spec), "nd-links")

    rooted = shared.join(components(links), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = written(rooted.select("key", "cid", "root", "members"), "nd-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("key")
    open_ = written(rooted.join(mixed, "key", "left_semi"), "nd-open")
    few = open_.filter(F.col("members") <= SMALL_BUCKET)
    left, right = (few.select("key", F.col("cid").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    direct = left.join(right, (left["key"] == right["key"]) & (left["a"] < right["b"]) & (left["ra"] != right["rb"])).select("a", "b").distinct()
    direct = close_pairs(direct, classes, spec)
    crowd = open_.filter(F.col("members") > SMALL_BUCKET).select("cid", "root").distinct()
    sets = shingle_sets(docs, classes, ends(direct).unionByName(crowd.select("cid")), spec, text, key)
    crossing = close_pairs(crowd_pairs(crowd, sets, spec), classes, spec)
    links = links.unionByName(confirmed(direct.unionByName(crossing).distinct(), sets, spec))

    rooted = classes.select("set_hash", "id", "cid").join(components(links), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    first = rooted.groupBy("root").agg(F.min(F.struct("id", "cid")).alias("first"))
    rooted = rooted.join(first, "root").select("set_hash", F.col("first.id").alias("root"), (F.col("first.cid") == F.col("cid")).alias("stays"))
    # rows that are linked with nothing go past the join, where they would share one key
    alone = F.col("id").isNull() | F.col("set_hash").isNull()
    linked = marks.filter(~alone).join(rooted, "set_hash")
    linked = linked.select("id", "text_hash", "n", "root", (F.col("stays") & (F.col("root") == F.col("id"))).alias("kept"))
    return linked.unionByName(marks.filter(alone).select("id", "text_hash", "n", F.col("id").alias("root"), F.lit(True).alias("kept")))


def near_classes(docs: DataFrame, spec: NearDupSpec, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    ``key`` is an integer. component_id is the smallest key reachable over links,
    the row's own included; kept marks the row that carries it. Rows with empty sets
    (null, empty or blank text) and rows with a null key are linked with nothing,
    and are kept. Very long texts are read whole, their shingles in blocks. A key may repeat over different texts: these are documents of their
    own, and if several of a class carry its smallest key, those of one set are kept.
    Rows that repeat key and set share a class and are kept or not together. Other
    columns may have any names; an empty table gives an empty result.
    """
    rows = _decided(docs, spec, text, key)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), "kept")


def keep_one_of_each(docs: DataFrame, spec: NearDupSpec, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without those that another document of the class stands for, with their columns of any names.

    Rows without words, without a text or without a key stay; texts are read whole, however long; of a class the rows stay that
    ``near_classes`` keeps, so that rows which repeat key and text stay or go together; an empty table stays empty.
    """
    gone = _decided(docs, spec, text, key).filter("NOT kept").select(F.col("id").alias("nd_key"), F.col("text_hash").alias("nd_text")).distinct()
    same = (F.col("in_1").cast("bigint") == F.col("nd_key")) & (text_hash(F.col("in_0")) == F.col("nd_text"))
    return released(carried(docs, text, key).join(small_side(written(gone, "nd-gone"), BROADCAST_IDS), same, "left_anti"))

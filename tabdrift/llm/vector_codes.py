"""Product codes of vectors by Lloyd's method on partition-local cover trees.

Vectors become whole numbers and are cut into equal parts, each part position with a
codebook of its own. A task builds one cover tree per block of vectors and part position, once. Every
node knows a point, the radius around it that holds its subtree, and where the
subtree lies in an order in which subtrees are runs, so running sums give the sum of any subtree by
one subtraction. A round walks down the trees with the codebook: by the triangle inequality a node whose
ball is nearer to one entry than to all others is assigned whole; only ambiguous
nodes descend, and only what is ambiguous at the leaves is compared vector by vector.
All sums and comparisons that decide are of whole numbers, so the result is Lloyd's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabdrift.llm.common import small_side, written

#: Vectors of a block, whose trees are built and kept together, and of a leaf.
BLOCK, LEAF = 4096, 12
#: Largest whole number of a component, so that squared distances of 64 components fit 64 bits.
LARGEST = 1 << 27
#: Most labels whose error is broadcast to the vectors; with more, they are joined by shuffle.
BROADCAST_LABELS = 100_000
_PRECISION = 1e-9


@dataclass(frozen=True)
class CodeSpec:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: float = 4096.0


@dataclass
class Tree:
    """Nodes level by level; node i holds ``order[begin[i]:end[i]]`` and has the children ``first[i]`` to ``last[i]``."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    point: np.ndarray
    radius: np.ndarray


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exact: [len(x), len(y)]."""
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - y[None, :, k]
        out += d * d
    return out


def cover_tree(x: np.ndarray) -> Tree:
    """A cover tree over the rows of ``x``, top down: a node's children cover its points within half the
    node's scale, and their points are farther from each other than that. Equal rows are one leaf."""
    order = np.arange(len(x))
    nodes = [[0, len(x), 0, 0, 0, 0.0, None]]  # begin, end, first, last, point, radius, scale
    at = 0
    while at < len(nodes):
        begin, end, *_, scale = nodes[at]
        own = order[begin:end].copy()
        d = np.sqrt(squares(x[own], x[own[:1]])[:, 0].astype(float))
        radius = float(d.max())
        nodes[at][4], nodes[at][5] = int(own[0]), radius
        if end - begin > LEAF and radius > 0:
            half = min(radius, scale if scale is not None else radius) / 2
            first, place = len(nodes), begin
            while len(own):
                near = d <= half
                inside = own[near]
                order[place : place + len(inside)] = inside
                nodes.append([place, place + len(inside), 0, 0, 0, 0.0, half])
                place += len(inside)
                own = own[~near]
                if len(own):
                    d = np.sqrt(squares(x[own], x[own[:1]])[:, 0].astype(float))
            nodes[at][2], nodes[at][3] = first, len(nodes)
        at += 1
    begin, end, first, last, point, radius, _ = zip(*nodes, strict=True)
    ints = (np.array(c, np.int64) for c in (begin, end, first, last, point))
    return Tree(order, *ints, np.array(radius))


def _runs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    long = end - begin
    return np.arange(long.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(long)[:-1]]), long)


def settle(tree: Tree, x: np.ndarray, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Assign every row of ``x`` to the nearest row of ``book``, the first on ties.

    Returns the nodes that were assigned whole, as pairs (nodes, entries), and the places in the tree's order that
    were compared one by one, with their entries.
    """
    whole, places, picked = [], [], []
    level, able = np.array([0]), np.ones((1, len(book)), bool)
    while len(level):
        square = squares(x[tree.point[level]], book)
        square[~able] = np.iinfo(np.int64).max
        best = square.argmin(1)
        d = np.sqrt(square.astype(float))
        reach = d[np.arange(len(level)), best] + 2 * tree.radius[level]
        able &= d <= (reach * (1 + _PRECISION) + _PRECISION)[:, None]
        alone = able.sum(1) == 1
        # a ball of one point needs no bound: its nearest entry is known
        alone |= tree.radius[level] == 0
        whole.append((level[alone], best[alone]))
        level, able = level[~alone], able[~alone]
        leaf = tree.first[level] == tree.last[level]
        if leaf.any():
            at = _runs(tree.begin[level[leaf]], tree.end[level[leaf]])
            square = squares(x[tree.order[at]], book)
            square[~np.repeat(able[leaf], tree.end[level[leaf]] - tree.begin[level[leaf]], axis=0)] = np.iinfo(np.int64).max
            places.append(at)
            picked.append(square.argmin(1))
        level, able = level[~leaf], able[~leaf]
        able = np.repeat(able, tree.last[level] - tree.first[level], axis=0)
        level = _runs(tree.first[level], tree.last[level])
    at = np.concatenate([np.empty(0, np.int64), *places])
    return whole, at, np.concatenate([np.empty(0, np.int64), *picked])


def entry_sums(tree: Tree, x: np.ndarray, upto: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the rows that each entry of ``book`` takes; ``upto`` are the running sums in the tree's order."""
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    whole, at, picked = settle(tree, x, book)
    for nodes, entry in whole:
        np.add.at(sums, entry, upto[tree.end[nodes]] - upto[tree.begin[nodes]])
        np.add.at(counts, entry, tree.end[nodes] - tree.begin[nodes])
    np.add.at(sums, picked, x[tree.order[at]])
    np.add.at(counts, picked, 1)
    return sums, counts


def codes(tree: Tree, x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entry of every row."""
    whole, at, picked = settle(tree, x, book)
    out = np.empty(len(x), np.int64)
    for nodes, entry in whole:
        out[tree.order[_runs(tree.begin[nodes], tree.end[nodes])]] = np.repeat(entry, tree.end[nodes] - tree.begin[nodes])
    out[tree.order[at]] = picked
    return out


_TREE = [("order", np.int32), ("begin", np.int32), ("end", np.int32), ("first", np.int32), ("last", np.int32), ("point", np.int32), ("radius", np.float64)]
_BLOCK_SCHEMA = "ids array<bigint>, labels array<bigint>, vectors binary, trees array<struct<" + ", ".join(f"`{n}`: binary" for n, _ in _TREE) + ">>"


def whole_numbers(vectors: list, width: int, scale: float) -> np.ndarray:
    """floor(scale x) of every component, held within ``LARGEST``; short vectors are filled with zeros to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.clip(np.floor(out * scale), -LARGEST, LARGEST).astype(np.int64)


def tree_blocks(rows: DataFrame, width: int, spec: CodeSpec) -> DataFrame:
    """Blocks of at most ``BLOCK`` rows (vc_key, vc_label, vector) with their whole numbers and a tree per part; written."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            taken = held[:BLOCK]
            del held[:BLOCK]
            x = whole_numbers([v for *_, v in taken], width, spec.scale)
            trees = [{n: getattr(t, n).astype(k).tobytes() for n, k in _TREE} for t in map(cover_tree, np.split(x, spec.parts, axis=1))]
            columns = [[[k for k, *_ in taken]], [[l for _, l, _ in taken]], [x.astype(np.int32).tobytes()], [trees]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.struct([(n, pa.binary()) for n, _ in _TREE]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["ids", "labels", "vectors", "trees"])

        for batch in batches:
            held += zip(batch.column("vc_key").to_pylist(), batch.column("vc_label").to_pylist(), batch.column("vector").to_pylist(), strict=True)
            while len(held) >= BLOCK:
                yield block()
        if held:
            yield block()

    return written(rows.mapInArrow(build, _BLOCK_SCHEMA), "vc-trees")


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list, np.ndarray, list[Tree]]]:
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["vectors"], np.int32).astype(np.int64).reshape(-1, width)
            trees = [Tree(*(np.frombuffer(t[n], k) for n, k in _TREE)) for t in row["trees"]]
            yield row["ids"], row["labels"], x, trees


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks [parts, entries, length] after one round: each entry the floored mean of what it takes.

    A task adds up its blocks and hands on one row a number; the driver sees a sum per
    number of the codebooks.
    """
    parts, entries, length = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, _, x, trees in _unpacked(batches, parts * length):
            for p, tree in enumerate(trees):
                part = np.ascontiguousarray(x[:, p * length : (p + 1) * length])
                upto = np.concatenate([np.zeros((1, length), np.int64), np.cumsum(part[tree.order], axis=0)])
                s, n = entry_sums(tree, part, upto, books[p])
                sums[p] += s
                counts[p] += n
        place = np.arange(books.size)
        total, n = sums.ravel(), np.repeat(counts.ravel(), length)
        keep = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(place[keep]), pa.array(total[keep]), pa.array(n[keep])], names=["place", "total", "n"])

    summed = blocks.mapInArrow(add, "place bigint, total bigint, n bigint").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.ravel().copy()
    for r in summed.collect():
        out[r["place"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vc_key, vc_label, code (two hex digits a part) and error of every vector."""
    parts, _, length = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for ids, labels, x, trees in _unpacked(batches, parts * length):
            text, error = np.full(len(x), "", f"<U{2 * parts}"), np.zeros(len(x), np.int64)
            for p, tree in enumerate(trees):
                part = np.ascontiguousarray(x[:, p * length : (p + 1) * length])
                found = codes(tree, part, books[p])
                gap = part - books[p][found]
                error += (gap * gap).sum(1)
                text = np.char.add(text, digits[found])
            columns = [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(text.tolist(), pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["vc_key", "vc_label", "code", "error"])

    return blocks.mapInArrow(code, "vc_key bigint, vc_label bigint, code string, error bigint")


def compress(rows: DataFrame, spec: CodeSpec, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Key, label, code, error and label_error of every usable row, and the codebooks [parts, entries, length].

    Key and label are integers. Rows whose vector is null or holds null or non-finite components
    are dropped. Vectors of unequal length, or of one that the parts do not divide, are filled with zeros up to the
    next length of the longest. Components beyond ``LARGEST`` after scaling count as that. The codebooks start from the
    smallest keys, null last, rows of equal key in order of their vectors; fewer rows than
    entries give as many entries. A label's error is summed over its rows, null being a label. Repeated
    rows are coded alike; an empty table gives an empty result. Other columns may have any names.

    Vectors are read to be measured, for the first entries, and for the trees, which are
    written once; rounds read the trees. Up to 256 ``entries``.
    """
    v = F.col(f"`{vector}`")
    fit = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(fit).select(F.col(f"`{key}`").cast("bigint").alias("vc_key"), F.col(f"`{label}`").cast("bigint").alias("vc_label"), v.cast("array<double>").alias("vector"))
    longest = good.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(-(-longest // spec.parts), 1) * spec.parts
    seeds = good.orderBy(F.col("vc_key").asc_nulls_last(), "vector").limit(spec.entries).collect()
    first = whole_numbers([r["vector"] for r in seeds], width, spec.scale)
    books = first.reshape(len(seeds), spec.parts, width // spec.parts).transpose(1, 0, 2).copy()
    blocks = tree_blocks(good, width, spec)
    for _ in range(spec.rounds if len(seeds) else 0):
        books = lloyd_round(blocks, books)
    out = written(coded(blocks, books), "vc-coded")
    errors = out.groupBy(F.col("vc_label").alias("_l")).agg(F.sum("error").alias("label_error"))
    out = out.join(small_side(written(errors, "vc-errors"), BROADCAST_LABELS), F.col("vc_label").eqNullSafe(F.col("_l")))
    return out.select(F.col("vc_key").alias(key), F.col("vc_label").alias(label), "code", "error", "label_error"), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, decimal and joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def reconstructed(code: str, books: np.ndarray, spec: CodeSpec) -> np.ndarray:
    """The vector that a code stands for: the middle of its components' steps."""
    entries = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
    return (np.concatenate([books[p][e] for p, e in enumerate(entries)]) + 0.5) / spec.scale


def oracle_sql(spec: CodeSpec = CodeSpec()) -> str:
    """The same rows, every round a statement of its own, for vectors of one length that the parts divide."""
    near = """SELECT id, p, arg_min(e, d) AS e, min(d) AS d FROM (SELECT x.id, x.p, b.e,
    CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 256 + b.e AS d FROM cut x JOIN {b} b ON x.p = b.p) GROUP BY id, p"""
    rounds = "".join(
        f"""near{r} AS MATERIALIZED ({near.format(b=f"book{r}")}),
mean{r} AS (SELECT p, e, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, generate_subscripts(v, 1) AS i, unnest(v) AS c FROM near{r} JOIN cut USING (id, p)) GROUP BY p, e, i),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN
  (SELECT p, e, list(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY i) AS v FROM mean{r} GROUP BY p, e) m USING (p, e)),
"""
        for r in range(spec.rounds)
    )
    return f"""
WITH good AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({spec.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT id, p, w[p * (len(w) // {spec.parts}) + 1 : (p + 1) * (len(w) // {spec.parts})] AS v FROM good, (SELECT unnest(range({spec.parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, CAST(id - 1 AS BIGINT) AS e, v FROM cut WHERE id <= {spec.entries}),
{rounds}last AS MATERIALIZED ({near.format(b=f"book{spec.rounds}")}),
coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d // 256) AS BIGINT) AS error FROM last GROUP BY id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{spec.rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN good USING (id), digest"""

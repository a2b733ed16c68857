"""Near-duplicate classes of embeddings by range search on a robust-pruned flat graph.

Vectors are compared within their group: equal label, equal length. Equal vectors are one
vertex. A unit is a set of vertices that a task can hold. In a unit, clusters of vertices, each
vertex in its nearest ones, are shards that overlap; its task builds the graph of each shard, and the
adjacency lists of all shards are united, so that vectors move to their unit once and lists not at all. On the united graph every vertex is a query: a beam
search goes from the medoids to its neighbourhood, and from what is near enough the range is
expanded until nothing new lies in it. Cosines are verified in double precision, components
are joined over all units, and the recall is audited against brute force for a sample of vertices;
where it falls short the graph is built again, wider.

A group that is larger than a unit is split by centroids. A vertex is at home in the cell of its nearest
centroid and visits every cell on whose side of the bisector a linked vector may lie. Where that would make more
copies than tiles do, as with vectors that lie in all directions, the group is dealt as tiles, each pair of tiles being a unit, which loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabdrift.llm.common import small_side, written
from tabdrift.llm.near_dedup import components

#: Queries that are searched side by side, and numbers of centroids that one round of splits ships to the tasks.
SIDE_BY_SIDE, SHIPPED = 512, 8_000_000
#: Components of the vectors that a task searches, at most.
COMPONENTS = 1 << 23
#: Cosines that are held at once where rows are compared with all of a shard.
HELD = 1 << 20
#: Most vertices that are broadcast to the rows; with more, they are joined by shuffle.
BROADCAST_VERTICES = 400_000


@dataclass(frozen=True)
class GraphSpec:
    """``unit`` bounds the vertices that a task searches, with long vectors ``COMPONENTS`` does, and ``shard`` those it builds a graph of, in the mean.

    A vertex has ``degree`` neighbours in a shard, pruned with ``alpha``, and lies in ``overlap`` shards;
    ``beam`` is the width of the search, which expands what is within ``slack`` of the threshold. Cells are visited up to
    ``spread`` deviations of a linked vector's way across their border, as if that way had no preferred direction.
    ``audit`` vertices are compared with all.
    """

    cosine: float = 0.93
    unit: int = 131_072
    shard: int = 2_048
    overlap: int = 2
    degree: int = 16
    alpha: float = 1.2
    beam: int = 40
    passes: int = 2
    slack: float = 0.03
    spread: float = 4.0
    audit: int = 256
    recall: float = 0.95
    attempts: int = 3

    def held(self, dim: int) -> int:
        """The vertices of that length that a task searches, at most."""
        return min(self.unit, max(2, COMPONENTS // dim))


# --- graphs in one task -----------------------------------------------------------------------------------------


def robust_prune(v: np.ndarray, at: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of the candidates ``near`` [len(at), K] of the vertices ``at``, -1 being none, up to ``degree`` each.

    The nearest candidate stays and takes out all that are nearer to it, by the factor
    ``alpha``, than to the vertex; then the nearest that is left, and so on. Room that is left goes to the
    nearest of those taken out: in a cloud of near copies all would hang on its middle alone.
    """
    near = np.where(near == at[:, None], -1, near)
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    sims = np.where(near < 0, -np.inf, (v[near] @ v[at][:, :, None])[:, :, 0])
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    own = v[near]
    gap, between = 2 - 2 * sims, 2 - 2 * own @ own.transpose(0, 2, 1)
    alive, kept, room = near >= 0, np.zeros(near.shape, bool), np.full(len(at), degree)
    for j in range(near.shape[1]):
        take = alive[:, j] & (room > 0)
        kept[:, j] = take
        room -= take
        alive &= ~(take[:, None] & (alpha * alpha * between[:, j] <= gap))
    spare = (near >= 0) & ~kept
    kept |= spare & (np.cumsum(spare, axis=1) <= room[:, None])
    out = np.full((len(at), degree), -1, np.int32)
    rows, cols = np.nonzero(kept)
    out[rows, (np.cumsum(kept, axis=1) - 1)[rows, cols]] = near[rows, cols]
    return out


def _new_pairs(seen: np.ndarray, q: np.ndarray, nodes: np.ndarray, graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, neighbour) of the nodes that queries expand, which were not seen before; now they are."""
    near = graph[nodes]
    who = np.repeat(q, near.shape[1]), near.ravel()
    fresh = (who[1] >= 0) & ~seen[who[0], who[1]]
    key = np.unique(who[0][fresh].astype(np.int64) * seen.shape[1] + who[1][fresh])
    seen.reshape(-1)[key] = True
    return key // seen.shape[1], key % seen.shape[1]


def beam_search(v: np.ndarray, graph: np.ndarray, wanted: np.ndarray, starts: np.ndarray, beam: int, least: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vertices that greedy searches end with, [len(wanted), beam] by falling cosine, -1 being none; and
    the pairs (query, vertex) with a cosine of ``least`` or more that the searches and the expansion of that range met.

    ``starts`` [len(wanted), any] are where each search begins.
    """
    n, wide = len(wanted), np.arange(len(wanted))
    seen = np.zeros((n, len(v)), bool)
    ids, sims, done = np.full((n, beam), -1), np.full((n, beam), -np.inf), np.zeros((n, beam), bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.einsum("id,id->i", wanted[q], v[x])
        hits.append((q[s >= least], x[s >= least]))
        return q, x, s

    def enter(q: np.ndarray, x: np.ndarray, s: np.ndarray) -> None:
        """``q`` rises; its new vertices take their places in the beams."""
        nonlocal ids, sims, done
        if not len(q):
            return
        long = np.bincount(q, minlength=n)
        place = np.arange(len(q)) - np.repeat(np.cumsum(long) - long, long)
        more = np.full((n, long.max()), -1), np.full((n, long.max()), -np.inf)
        more[0][q, place], more[1][q, place] = x, s
        ids, sims, done = np.hstack([ids, more[0]]), np.hstack([sims, more[1]]), np.hstack([done, np.zeros(more[0].shape, bool)])
        top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims, done = (np.take_along_axis(a, top, 1) for a in (ids, sims, done))

    key = np.unique((wide[:, None] * len(v) + starts)[starts >= 0])
    seen.reshape(-1)[key] = True
    enter(*meet(key // len(v), key % len(v)))
    while True:
        live = ~done & (ids >= 0)
        pick = np.cumsum(live, axis=1) <= 4
        q, at = np.nonzero(live & pick)
        if not len(q):
            break
        done[q, at] = True
        enter(*meet(*_new_pairs(seen, q, ids[q, at], graph)))
    spread = 0
    while spread < len(hits):
        # what the searches met within the range, and then what its expansion meets, whole rounds at a time
        q, x = (np.concatenate([h[i] for h in hits[spread:]]) for i in (0, 1))
        spread = len(hits)
        if len(q):
            meet(*_new_pairs(seen, q, x, graph))
    return ids, *(np.concatenate([h[i] for h in hits]) for i in (0, 1))


def _blocks(rows: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rows, -(-len(rows) // SIDE_BY_SIDE)) if len(rows) else []


def nearest_rows(v: np.ndarray, at: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` rows of ``v`` out of ``among`` that are nearest to each of the rows ``at``, in no order, or all if they are fewer."""
    if len(among) <= most:
        return np.broadcast_to(among, (len(at), len(among)))
    others, step = v[among].T, max(1, HELD // len(among))
    return np.concatenate([among[np.argpartition(-(v[at[i : i + step]] @ others), most - 1, axis=1)[:, :most]] for i in range(0, len(at), step)])


def build_graph(v: np.ndarray, spec: GraphSpec, seed: int = 7) -> tuple[np.ndarray, int]:
    """A robust-pruned graph over the rows of ``v`` [n, degree], -1 being none, and the medoid.

    Vertices are inserted in batches that double: each prunes the nearest of those before it, and is entered into the lists
    of its neighbours, which are pruned when full. Further ``passes`` do it with the nearest of all. A shard is small, so
    they are found by products of whole blocks, at a fraction of what as many searches of the growing graph cost.
    """
    n = len(v)
    medoid = int((v @ v.mean(0)).argmax())
    graph = np.full((n, spec.degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])

    def insert(batch: np.ndarray, among: np.ndarray) -> None:
        for part in _blocks(batch):
            graph[part] = robust_prune(v, part, np.hstack([nearest_rows(v, part, among, spec.beam), graph[part]]), spec.degree, spec.alpha)
        source, place = np.nonzero(graph[batch] >= 0)
        to, source = graph[batch][source, place], batch[source]
        rank = np.argsort(to, kind="stable")
        to, source = to[rank], source[rank]
        target, first, long = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(target), min(int(long.max(initial=0)), 3 * spec.degree)), -1, np.int64)
        at = np.arange(len(to)) - np.repeat(first, long)
        keep = at < more.shape[1]
        more[np.repeat(np.arange(len(target)), long)[keep], at[keep]] = source[keep]
        for part in _blocks(np.arange(len(target))):
            graph[target[part]] = robust_prune(v, target[part], np.hstack([graph[target[part]], more[part]]), spec.degree, spec.alpha)

    for turn in range(spec.passes):
        at, size = (0, 4 * SIDE_BY_SIDE) if turn else (1, 1)
        while at < n:
            insert(order[at : at + size], order if turn else order[:at])
            at, size = at + size, max(size, min(2 * size, SIDE_BY_SIDE))
    return graph, medoid


def reachable(graph: np.ndarray, least: int = 8) -> list[np.ndarray]:
    """The adjacency lists of ``graph``, in which whatever fewer than ``least`` others lead to is led to by its own nearest neighbours as well."""
    entries = np.bincount(graph[graph >= 0], minlength=len(graph))
    poor = np.flatnonzero(entries < least)
    lists = [g[g >= 0] for g in graph]
    more: dict[int, list[int]] = {}
    for p in poor.tolist():
        for x in lists[p][:least].tolist():
            more.setdefault(x, []).append(p)
    for x, extra in more.items():
        lists[x] = np.union1d(lists[x], extra)
    return lists


def padded(lists: list[np.ndarray]) -> np.ndarray:
    """Lists as rows of one matrix, filled with -1."""
    long = np.array([len(g) for g in lists])
    out = np.full((len(lists), max(1, int(long.max(initial=0)))), -1, np.int64)
    rows = np.repeat(np.arange(len(lists)), long)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(long) - long, long)] = np.concatenate([np.empty(0, np.int64), *lists])
    return out


def nearest_centroids(v: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """``k`` centroids of the rows of ``v``, or fewer, by Lloyd's method on a sample of 64 rows a centroid."""
    rng = np.random.default_rng(seed)
    some = v[rng.permutation(len(v))[: 64 * k]]
    book = some[:k].copy()
    for _ in range(rounds):
        own = (some @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
        n = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, some)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def _hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of the pairs (a, b) in ``root``, the least vertex of a tree being its root."""
    while True:
        while (root[root] != root).any():
            root[:] = root[root]
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def search_unit(x: np.ndarray, graph: np.ndarray, medoids: np.ndarray, home: np.ndarray, side: np.ndarray, copies: np.ndarray, spec: GraphSpec) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of ``x``: how many vectors the home ones link to in this unit, copies counted, and a root each.

    Where rows of two sides are present only links between the sides count. Pairs are verified in double precision
    and forgotten block by block.
    """
    norm = np.sqrt((x * x).sum(1))
    v = (x / norm[:, None]).astype(np.float32)
    links, root, cross = np.zeros(len(x), np.int64), np.arange(len(x)), len(np.unique(side)) > 1
    queries = np.flatnonzero(home)
    for block in _blocks(queries):
        starts = np.hstack([np.broadcast_to(medoids, (len(block), len(medoids))), block[:, None]])
        _, q, y = beam_search(v, graph, v[block], starts, spec.beam, spec.cosine - spec.slack)
        q = block[q]
        keep = (q != y) & ((side[q] != side[y]) | (not cross))
        q, y = q[keep], y[keep]
        sure = np.concatenate([np.empty(0, bool), *((x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= spec.cosine for a, b in _slices(q, y))])
        q, y = q[sure], y[sure]
        links += np.bincount(q, copies[y], len(x)).astype(np.int64)
        _hooked(root, q, y)
    return links, root


def _slices(a: np.ndarray, b: np.ndarray, size: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), size):
        yield a[i : i + size], b[i : i + size]


# --- tables -----------------------------------------------------------------------------------------------------


def _usable(vector, label):
    """Whether a row can link: a label, and a vector of finite components that are not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def _component(rows: DataFrame) -> str:
    """The type of the components in column vec."""
    return rows.schema["vec"].dataType.elementType.simpleString()


def _whole(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def split_units(vertices: DataFrame, spec: GraphSpec) -> DataFrame:
    """Rows (unit, cid, home, side, copies, vec): every two vertices of a group that can be linked share a unit in which one of them
    is at home, but for a small chance that ``spread`` sets.

    Without ``copies`` a vertex counts once. Each round splits the units that are too large, as many as their centroids fit ``SHIPPED`` numbers; the
    driver sees these centroids and their units. Centroids come from a bounded sample of a unit.
    """
    spark = vertices.sparkSession
    copies = F.col("copies") if "copies" in vertices.columns else F.lit(1).cast("bigint").alias("copies")
    left = vertices.select(F.xxhash64("label", "dim").alias("unit"), "cid", F.lit(True).alias("home"), F.lit(0).alias("side"), copies, F.lit(0).cast("bigint").alias("of"), "dim", "vec")
    settled: list[DataFrame] = []
    while True:
        sizes = left.groupBy("unit").agg(F.count("*").alias("n"), F.max("of").alias("of"), F.max("dim").alias("dim")).filter(F.col("n") > _held(spec))
        widest = sizes.agg(F.max("dim")).first()[0]
        if widest is None:
            break
        most = max(1, SHIPPED // (32 * widest))
        large = sizes.orderBy("unit").limit(most + 1).collect()
        chosen = {r["unit"]: r for r in large[:most]}
        named = lambda rows, schema: left.join(F.broadcast(spark.createDataFrame(rows, f"unit bigint, {schema}")), "unit", "left")  # noqa: B023, E731
        books = _centroids(named([(u, r["n"]) for u, r in chosen.items() if r["n"] <= 0.8 * r["of"] or not r["of"]], "size bigint").filter("size IS NOT NULL"), chosen, spec)
        books = {u: book for u, (book, visits) in books.items() if _shrinks(chosen[u], len(book), visits, spec)}
        joined = named([(u, u not in books, r["n"]) for u, r in chosen.items()], "stuck boolean, size bigint")
        rest = joined.filter("stuck IS NULL").drop("stuck", "size")
        if len(large) <= most:
            settled.append(rest)
            rest = rest.limit(0)
        if len(books) < len(chosen):
            settled.append(_tiles(joined.filter("stuck"), spec))
        left = written(rest.unionByName(_cells(joined.filter("NOT stuck"), books, spec)), "ed-units")
    out = left
    for part in settled:
        out = out.unionByName(part)
    return out.drop("of", "dim")


def _held(spec: GraphSpec) -> Column:
    """``spec.held`` of column dim."""
    return F.least(F.lit(spec.unit), F.greatest(F.lit(2), F.floor(F.lit(COMPONENTS) / F.col("dim"))))


def _shrinks(unit: Row, cells: int, visits: float, spec: GraphSpec) -> bool:
    """Whether cells that a vertex visits so many of, and tiles of what is too large of them, make fewer copies than tiles at once."""
    tiled = lambda n: max(1.0, 2 * n / spec.held(unit["dim"]))
    return visits * tiled(unit["n"] * visits / cells) < tiled(unit["n"])


def _tiles(rows: DataFrame, spec: GraphSpec) -> DataFrame:
    """Rows of units that do not shrink, in all pairs of their tiles of half a unit each."""
    tiles = F.ceil(F.col("size") * 2 / _held(spec)).cast("int")
    tile = F.pmod(F.xxhash64("cid"), tiles).cast("int")
    dealt = rows.withColumn("_t", tile).withColumn("_o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    pair = F.xxhash64("unit", F.least("_t", "_o"), F.greatest("_t", "_o"))
    return dealt.select(pair.alias("unit"), "cid", "home", (F.col("_t") > F.col("_o")).cast("int").alias("side"), "copies", "of", "dim", "vec")


def _cells_of(size: int, held: int) -> int:
    return int(min(32, max(2, -(-2 * size // held))))


def _visited(v: np.ndarray, book: np.ndarray, spec: GraphSpec) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each row, and [rows, cells] whether it is there or visits."""
    far = 1 - 2 * v @ book.T + (book * book).sum(1)
    own = far.argmin(1)
    apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2))[own]
    border = (far - far[np.arange(len(v)), own][:, None]) / np.where(apart > 0, 2 * apart, np.inf)
    border[np.arange(len(v)), own] = 0
    chord = float(np.sqrt(2 - 2 * spec.cosine))
    return own, (border <= chord * min(1.0, spec.spread / np.sqrt(v.shape[1])) + 1e-6) & ((apart > 0) | (np.arange(len(book)) == own[:, None]))


def _centroids(rows: DataFrame, chosen: dict, spec: GraphSpec) -> dict[int, tuple[np.ndarray, float]]:
    """Centroids of each unit, from a sample of about 64 rows a centroid by their hashes, and how many cells a row of it is in, in the mean."""

    def fit(table: pa.Table) -> pa.Table:
        batch = _whole(table)
        v = _matrix(batch.column("vec"))
        v = v / np.sqrt((v * v).sum(1))[:, None]
        book = nearest_centroids(v, _cells_of(batch.column("size")[0].as_py(), spec.held(v.shape[1])))
        return pa.table({"unit": batch.column("unit").slice(0, 1), "book": pa.array([book.tobytes()], pa.binary()), "visits": pa.array([_visited(v, book, spec)[1].sum(1).mean()])})

    share = F.lit(64.0 * 32) / F.col("size")
    sample = rows.filter(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20)).select("unit", "size", "vec")
    found = sample.groupBy("unit").applyInArrow(fit, "unit bigint, book binary, visits double").collect()
    return {r["unit"]: (np.frombuffer(r["book"]).reshape(-1, chosen[r["unit"]]["dim"]), r["visits"]) for r in found}


def _cells(rows: DataFrame, books: dict[int, np.ndarray], spec: GraphSpec) -> DataFrame:
    """Each row in its own cell and in those it visits."""
    schema = f"unit bigint, cell int, cid bigint, home boolean, side int, copies bigint, of bigint, dim int, vec array<{_component(rows)}>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit").to_numpy()
            for unit in np.unique(units):
                part = batch.filter(pa.array(units == unit))
                v = _matrix(part.column("vec"))
                own, there = _visited(v / np.sqrt((v * v).sum(1))[:, None], books[int(unit)], spec)
                row, cell = np.nonzero(there)
                home = part.column("home").to_numpy(zero_copy_only=False)[row] & (cell == own[row])
                took = part.take(pa.array(row))
                columns = [took.column("unit"), pa.array(cell, pa.int32()), took.column("cid"), pa.array(home), took.column("side"), took.column("copies"), took.column("size"), took.column("dim"), took.column("vec")]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "cell", "cid", "home", "side", "copies", "of", "dim", "vec"])

    dealt = rows.select("unit", "cid", "home", "side", "copies", "size", "dim", "vec").mapInArrow(deal, schema)
    return dealt.withColumn("unit", F.xxhash64("unit", "cell")).drop("cell")


def united_graph(v: np.ndarray, spec: GraphSpec) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency of the rows of ``v``, united over overlapping cluster shards, as rows filled up with -1; and the medoids of the shards."""
    n = len(v)
    k = -(-n * spec.overlap // spec.shard) if n > spec.shard else 1
    book = nearest_centroids(v, k)
    size, overlap = (book * book).sum(1), min(spec.overlap, len(book))
    near = np.concatenate([np.argpartition(size - 2 * v[a] @ book.T, overlap - 1, axis=1)[:, :overlap] for a in np.array_split(np.arange(n), -(-n * len(book) // HELD))])
    row, shard = np.repeat(np.arange(n), overlap), near.ravel()
    order = np.argsort(shard, kind="stable")
    pairs, medoids = [], []
    for at in np.split(row[order], np.flatnonzero(np.diff(shard[order])) + 1):
        graph, medoid = build_graph(v[at], spec)
        lists = reachable(graph)
        pairs.append(np.repeat(at, [len(g) for g in lists]) * n + at[np.concatenate(lists).astype(np.int64)])
        medoids.append(at[medoid])
    pairs = np.unique(np.concatenate(pairs))
    return padded(np.split(pairs % n, np.searchsorted(pairs, np.arange(1, n) * n))), np.unique(medoids)


def range_links(units: DataFrame, spec: GraphSpec) -> DataFrame:
    """Rows (cid, links, root): links of the vertices at home in a unit, and a vertex that each of a unit's is connected with.

    A unit's graph is built where it is searched.
    """
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def search(vectors: pa.Table) -> pa.Table:
        batch = _whole(vectors.sort_by("cid"))
        x, cid = _matrix(batch.column("vec")), batch.column("cid").to_numpy()
        graph, medoids = united_graph((x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32), spec)
        flag = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        links, root = search_unit(x, graph, medoids, flag("home"), flag("side"), flag("copies"), spec)
        return pa.table({"cid": batch.column("cid"), "links": pa.array(links), "root": pa.array(cid[root])}, schema=schema)

    return units.select("unit", "cid", "home", "side", "copies", "vec").groupBy("unit").applyInArrow(search, "cid bigint, links bigint, root bigint")


def audited_recall(vertices: DataFrame, found: DataFrame, spec: GraphSpec) -> float:
    """Share of the links of ``audit`` vertices, those of the smallest hashes, that were found; 1 without any."""
    some = vertices.orderBy(F.xxhash64("cid", F.lit(2)), "cid").limit(spec.audit).select("cid", "label", "dim", "vec").collect()
    if not some:
        return 1.0
    label, dim, cids = (np.array([r[c] for r in some], np.int64) for c in ("label", "dim", "cid"))
    wanted = [np.array(r["vec"]) for r in some]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(some), np.int64)
        for batch in batches:
            flag = lambda c: batch.column(c).to_numpy()  # noqa: B023, E731
            for d in np.unique(flag("dim")):
                at, of = np.flatnonzero(flag("dim") == d), np.flatnonzero(dim == d)
                if not len(of):
                    continue
                x, w = _matrix(batch.column("vec").take(pa.array(at))), np.stack([wanted[i] for i in of])
                cos = (w @ x.T) / (np.sqrt((w * w).sum(1))[:, None] * np.sqrt((x * x).sum(1)))
                linked = (cos >= spec.cosine) & (label[of][:, None] == flag("label")[at]) & (cids[of][:, None] != flag("cid")[at])
                total[of] += (linked * flag("copies")[at]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(total)], names=["cid", "true"])

    true = vertices.select("cid", "label", "dim", "vec", "copies").mapInArrow(compare, "cid bigint, true bigint").groupBy("cid").agg(F.sum("true").alias("true"))
    both = true.join(found, "cid", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first()
    return both[1] / both[0] if both[0] else 1.0


def near_vectors(rows: DataFrame, spec: GraphSpec, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, float]:
    """One row per row of ``rows``, key, n_links, component_id, kept; and the audited recall.

    Key and label are integers. Rows are compared where labels and lengths are equal. n_links counts the other rows
    with a cosine of at least ``spec.cosine``; component_id is the smallest key reachable over links, the
    row's own included; kept marks the row that carries it. Rows with a null key, a null label, or a vector that is null,
    empty, zero or holds null or non-finite components link with nothing and are kept. Rows that repeat a key and a vector are links of
    each other; a key may repeat over different vectors. An empty table gives an empty result. Other
    columns may have any names.
    """
    real = rows.schema[vector].dataType.elementType.simpleString()
    v, k, l = F.col(f"`{vector}`"), F.col(f"`{key}`").cast("bigint"), F.col(f"`{label}`").cast("bigint")
    digest = [F.xxhash64(F.lit(s), v).alias(f"h{s}") for s in (1, 2)]
    marks = rows.select(k.alias("id"), l.alias("label"), v.cast(f"array<{real if real == 'float' else 'double'}>").alias("vec"), F.size(v).alias("dim"), *digest, (k.isNotNull() & _usable(v, l)).alias("fit"))
    names = ["label", "dim", "h1", "h2"]
    vertices = marks.filter("fit").groupBy(*names).agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("vec").alias("vec"))
    vertices = written(vertices.withColumn("cid", F.monotonically_increasing_id()), "ed-vertices")
    units = split_units(vertices, spec)  # read from the vertices or the last split, not stored once more
    for attempt in range(spec.attempts):
        wide = replace(spec, beam=spec.beam << attempt, degree=spec.degree << attempt)
        found = written(range_links(units, wide), "ed-found")
        links = written(found.groupBy("cid").agg(F.sum("links").alias("links")), "ed-links")
        recall = audited_recall(vertices, links, wide)
        if recall >= spec.recall:
            break
    joined = components(found.filter("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    rooted = vertices.join(joined, "cid", "left").join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    rooted = rooted.join(least, "root").select(*names, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    fit = marks.filter("fit").select("id", *names).join(small_side(written(rooted, "ed-rooted"), BROADCAST_VERTICES), names)
    alone = marks.filter("NOT fit").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = fit.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), recall


def oracle_sql(spec: GraphSpec = GraphSpec()) -> str:
    """The same rows by comparing all pairs, where the audited recall is 1 and keys are unique."""
    return f"""
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {spec.cosine}),
reached AS (SELECT vec_id, vec_id AS other FROM good UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)"""

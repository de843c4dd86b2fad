"""The most similar vectors of every vector (problem 1).

An inverted index with balanced posting lists. The number of lists follows the
number of rows. Coarse centroids are fitted on a bounded sample at the driver; where
the table needs more lists than that sample supports, every coarse cell is clustered
again by a worker, on a sample of its own, so centroids grow with the rows. Clusters
that would grow too long are split again. The centroids form an in-memory neighbour
graph with the upper level as entry points; each vector walks it to its nearest
centroids. A vector near the border of its list is replicated to every list whose
centroid is within a distance ratio of the nearest one, and a tighter ratio selects
the lists in which it searches. Both ratios are set on the sample, per entry point, so
that the vectors of every region are stored in ``COPIES`` lists and search
``SEARCHES`` on average: a dense group takes no lists from the others.

The members of every list are counted after placement. A list of more than ``BLOCK``
members is cut into blocks by the hash of the ids, and each pair of blocks is a task's
work of its own: searchers of one, stored vectors of the other. Nothing is dropped, and
no task holds more than two blocks. Inside a block pair, vectors are compared by matrix
products.

Copies of one direction, whatever their norm, can be a large share of the rows. The
``HOT_DIRECTIONS`` most frequent directions with more than ``HOT_COPIES`` copies enter
the index once and get their copies back by key, without a shuffle of the copies; less
frequent ones are ordinary members. Unit vectors count as copies when they agree in 6
decimals: their cosine is 1 in the 7 decimals that count, and the cosines of a copy to
others differ by less than 0.00001.

Every row is indexed; only the centroids and the ratios come from samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotusflow.llm.common import arrow_map, table

#: Vectors of the sample for the coarse centroids, picked by the hash of their ids; the driver holds about this many.
SAMPLE_ROWS = 150_000

#: Vectors in a posting list before replication, on average.
LIST_SIZE = 1200

#: Sampled vectors a centroid is fitted on, and vectors of one coarse cell a worker clusters at most.
PER_CENTROID, CELL_SAMPLE = 64, 65_536

#: Lists a vector is stored in, at most and on average, and lists it searches on average.
REPLICAS, COPIES, SEARCHES = 8, 4.2, 4.0

#: Members of a list that one task holds of each side.
BLOCK = 16_384

#: Copies from which a direction enters the index once, and how many such directions there can be.
HOT_COPIES, HOT_DIRECTIONS = 64, 65_536

#: Neighbours of a centroid in the graph, and entry points whose centroids are looked through for them.
DEGREE, BESIDE = 24, 16


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 4_000_000 // max(1, len(centres)))
    return np.concatenate([(x[i : i + step] @ centres.T).argmax(1) for i in range(0, len(x), step)] or [np.empty(0, int)])


def _cluster(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; empty clusters restart at random members."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=k)
        filled = np.flatnonzero(counts)
        sums = np.add.reduceat(x[order], np.cumsum(counts)[filled] - counts[filled], axis=0)
        centres[filled] = sums
        empty = np.flatnonzero(counts == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
        centres = _unit(centres)
    return centres


class Graph:
    """Centroids, the upper level as entries, and the neighbour graph between them."""

    def __init__(self, entries: np.ndarray, centres: np.ndarray) -> None:
        self.entries, self.centres = entries, centres
        degree = min(DEGREE, len(centres) - 1)
        self.near = np.zeros((len(centres), degree), np.int32)
        self.region = _nearest(centres, entries)
        order = np.argsort(self.region, kind="stable")
        rings = np.split(order, np.cumsum(np.bincount(self.region, minlength=len(entries)))[:-1])
        sizes = np.array([len(r) for r in rings])
        # Neighbours are looked for among the centroids of the nearest entry points.
        for e, ring in enumerate(rings):
            if not len(ring) or not degree:
                continue
            beside = np.argsort(-(entries @ entries[e]), kind="stable")
            enough = int(np.searchsorted(np.cumsum(sizes[beside]), degree + 1)) + 1
            pool = np.concatenate([rings[b] for b in beside[: max(BESIDE, enough)]])
            likeness = centres[ring] @ centres[pool].T
            likeness[ring[:, None] == pool[None, :]] = -2
            self.near[ring] = pool[np.argpartition(-likeness, degree - 1, axis=1)[:, :degree]]
        # First frontier of an entry: its own centroids and two rings around them.
        self.frontier = []
        for e, ring in enumerate(rings):
            if not len(ring):
                ring = np.argsort(-(centres @ entries[e]))[:1]
            self.frontier.append(np.unique(np.concatenate([ring, self.near[ring].ravel()])).astype(np.int32))

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each vector and their cosines, best first.

        Vectors that enter at the same point expand the same frontier together; a
        vector whose best centroid has unseen neighbours goes on from there.
        """
        k = min(k, len(self.centres))
        ids = np.full((len(x), k), -1, np.int32)
        likeness = np.full((len(x), k), -2, np.float32)
        entry = _nearest(x, self.entries)
        order = np.argsort(entry, kind="stable")
        bounds = np.flatnonzero(np.diff(entry[order])) + 1
        for rows in np.split(order, bounds):
            if not len(rows):
                continue
            frontier = self.frontier[entry[rows[0]]]
            found = x[rows] @ self.centres[frontier].T
            top = min(k, found.shape[1])
            best = np.argpartition(-found, top - 1, axis=1)[:, :top]
            value = np.take_along_axis(found, best, 1)
            inner = np.argsort(-value, axis=1)
            ids[rows, :top] = frontier[np.take_along_axis(best, inner, 1)]
            likeness[rows, :top] = np.take_along_axis(value, inner, 1)
        # Greedy steps: expand the best centroid of each vector until it stays the best.
        active = np.arange(len(x))
        for _ in range(8):
            if not len(active) or self.near.shape[1] == 0:
                break
            at = ids[active, 0]
            moved = []
            for i in range(0, len(active), 4096):
                part, hop = active[i : i + 4096], self.near[at[i : i + 4096]]
                value = np.einsum("rd,rnd->rn", x[part], self.centres[hop])
                value[(hop[:, :, None] == ids[part][:, None, :]).any(2)] = -2
                all_ids = np.concatenate([ids[part], hop], 1)
                all_values = np.concatenate([likeness[part], value], 1)
                inner = np.argsort(-all_values, axis=1, kind="stable")[:, :k]
                new_ids = np.take_along_axis(all_ids, inner, 1)
                moved.append(part[new_ids[:, 0] != ids[part, 0]])
                ids[part], likeness[part] = new_ids, np.take_along_axis(all_values, inner, 1)
            active = np.concatenate(moved)
        return ids, likeness


def fit_graph(sample: np.ndarray, lists: int, seed: int = 7) -> Graph:
    """Two-level balanced clustering of unit vectors into about ``lists`` centroids.

    A cluster with more than twice its share of the sample is split again, so the
    posting lists stay balanced unless their vectors cannot be told apart.
    """
    lists = max(1, min(lists, len(sample)))
    upper = max(1, round(np.sqrt(lists)))
    entries = _cluster(sample, upper, 8, seed)
    share = max(2.0, len(sample) / lists)
    of = _nearest(sample, entries)
    centres = []
    for e in range(len(entries)):
        members = sample[of == e]
        if not len(members):
            continue
        work = [(members, max(1, round(len(members) / share)))]
        while work:
            part, k = work.pop()
            if k <= 1:
                centres.append(_unit(part.sum(0, keepdims=True)))
                continue
            made = _cluster(part, k, 6, seed)
            where = _nearest(part, made)
            for c in range(len(made)):
                inside = part[where == c]
                if len(inside) > 2 * share and len(inside) < len(part):
                    work.append((inside, max(2, round(len(inside) / share))))
                elif len(inside):
                    centres.append(made[c : c + 1])
    return Graph(entries, np.concatenate(centres))


def fit_ratio(likeness: np.ndarray, average: float) -> float:
    """The distance ratio within which ``average`` of the nearest centroids lie."""
    if likeness.shape[1] < 2:
        return 1.0
    far = np.maximum(2 - 2 * likeness, 0)
    ratios = (far / np.maximum(far[:, :1], 1e-9))[:, 1:].ravel()
    return float(np.quantile(ratios, min(1.0, (average - 1) / (likeness.shape[1] - 1))))


def fit_ratios(graph: Graph, ids: np.ndarray, likeness: np.ndarray, average: float) -> np.ndarray:
    """The distance ratio of each centroid, for vectors nearest to it.

    It lets the sampled vectors of its entry point reach ``average`` lists; entry
    points with fewer than 32 of them take the ratio of the whole sample.
    """
    ratios = np.full(len(graph.centres), fit_ratio(likeness, average))
    at = graph.region[ids[:, 0]]
    for e in np.flatnonzero(np.bincount(at, minlength=len(graph.entries)) >= 32):
        ratios[graph.region == e] = fit_ratio(likeness[at == e], average)
    return ratios


def _vectors(batch_column: pa.Array, dim: int) -> np.ndarray:
    flat = batch_column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float32).reshape(-1, dim)


def _fine_centroids(rows: DataFrame, graph: Graph, sample: np.ndarray, dim: int, lists: int, share: float, cell_sample: int) -> np.ndarray:
    """Centroids fitted by the workers inside every coarse cell, about ``lists`` together.

    ``rows`` has ``mark`` (a hash of the id) and ``vector``. A cell is fitted on
    ``share`` of its vectors, at most about ``cell_sample``; it gets centroids by its
    part of the coarse sample. What returns is one vector per list, which every worker
    needs for the search anyway.
    """
    cells = len(graph.centres)
    parts = np.bincount(graph.search(sample, 1)[0][:, 0], minlength=cells) / len(sample)
    wanted = np.maximum(1, np.round(parts * lists)).astype(int)
    expected = parts * wanted.sum() * PER_CENTROID
    limit = (np.minimum(1.0, cell_sample / np.maximum(expected, 1)) * share * (1 << 30)).astype(np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_vectors(batch.column("vector"), dim))
            cell = graph.search(x, 1)[0][:, 0]
            keep = pa.array(batch.column("mark").to_numpy() < limit[cell])
            made = pa.RecordBatch.from_arrays([pa.array(cell), batch.column("mark"), batch.column("vector")], names=["cell", "mark", "vector"])
            yield made.filter(keep)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "cell"):
            cell = group.column("cell")[0].as_py()
            made = fit_graph(_unit(_vectors(group.column("vector").combine_chunks(), dim)), int(wanted[cell])).centres
            yield pa.RecordBatch.from_arrays([pa.array([cell] * len(made), pa.int32()), pa.array(made.tolist(), pa.list_(pa.float32()))], names=["cell", "vector"])

    picked = arrow_map(rows.where(F.col("mark") < int(share * (1 << 30))), pick, "cell int, mark long, vector array<float>")
    fitted = arrow_map(picked.repartition("cell").sortWithinPartitions("cell", "mark"), fit, "cell int, vector array<float>")
    arrow = fitted.orderBy("cell", "vector").toArrow()
    made = _vectors(arrow.column("vector").combine_chunks(), dim) if arrow.num_rows else np.zeros((0, dim), np.float32)
    unseen = np.setdiff1d(np.arange(cells), arrow.column("cell").to_numpy())
    return np.concatenate([made, graph.centres[unseen]])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table per key of a sorted partition; only the rows of the current key are held."""
    pending: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = batch.column(key).to_numpy()
        heads = np.flatnonzero(np.diff(marks, prepend=marks[0] - 1))
        for start, end in zip(heads, np.append(heads[1:], len(marks)), strict=True):
            if pending and marks[start] != current:
                yield pa.Table.from_batches(pending)
                pending = []
            current = marks[start]
            pending.append(batch.slice(start, end - start))
    if pending:
        yield pa.Table.from_batches(pending)


class Placement:
    """Decides the lists of a vector; lists above a size are cut into ``blocks``."""

    def __init__(self, graph: Graph, dim: int, replicas: int, store_ratios: np.ndarray, search_ratios: np.ndarray) -> None:
        self.graph, self.dim, self.replicas = graph, dim, replicas
        self.store_ratios, self.search_ratios = store_ratios, search_ratios
        self.blocks = np.ones(len(graph.centres), np.int64)

    def cut(self, members: np.ndarray, block: int) -> None:
        """Set the blocks from the number of members of each list."""
        self.blocks = np.maximum(1, -(-members // block)).astype(np.int64)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, searches) of every copy of unit vectors."""
        ids, likeness = self.graph.search(x, self.replicas)
        far = np.maximum(2 - 2 * likeness, 0)
        ratio = far / np.maximum(far[:, :1], 1e-9)
        first = np.arange(ids.shape[1])[None, :] == 0
        nearest = ids[:, :1]
        stored = ((ratio <= self.store_ratios[nearest]) | first) & (ids >= 0)
        searched = stored & ((ratio <= self.search_ratios[nearest]) | first)
        rows, cols = np.nonzero(stored)
        return rows, ids[rows, cols], searched[rows, cols]

    def cells(self, at: np.ndarray, searches: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(copy, cell, role) for copies in list ``at``: role 1 searches, 2 is searched, 3 both.

        The cell of a list with one block is the list's only one; else a copy is
        searched in the cells of its block's column and searches along its row.
        """
        base = np.cumsum(self.blocks**2) - self.blocks**2
        b = self.blocks[at]
        own = mark % b
        copy = np.repeat(np.arange(len(at)), b)
        step = np.arange(len(copy)) - np.repeat(np.cumsum(b) - b, b)
        down = base[at[copy]] + step * b[copy] + own[copy]
        role = np.where((step == own[copy]) & searches[copy], 3, 2)
        across = np.flatnonzero((step != own[copy]) & searches[copy])
        more = copy[across]
        return (
            np.concatenate([copy, more]),
            np.concatenate([down, base[at[more]] + own[more] * b[more] + step[across]]),
            np.concatenate([role, np.ones(len(across), np.int64)]),
        )


def _count_members(place: Placement):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(place.graph.centres), np.int64)
        for batch in batches:
            x = _unit(_vectors(batch.column("vector"), place.dim))
            for i in range(0, len(x), 8192):
                total += np.bincount(place.lists(x[i : i + 8192])[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["list", "n"])

    return run


def _assign(place: Placement):
    dim = place.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_vectors(batch.column("vector"), dim))
            marks = batch.column("mark").to_numpy()
            for i in range(0, len(x), 8192):
                part = x[i : i + 8192]
                rows, at, searches = place.lists(part)
                copy, cell, role = place.cells(at, searches, marks[i + rows])
                unit = part[rows[copy]]
                offsets = np.arange(0, (len(copy) + 1) * dim, dim, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell),
                        pa.array(role.astype(np.int8)),
                        batch.column("id").take(pa.array(rows[copy] + i)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel())),
                    ],
                    names=["cell", "role", "id", "vector"],
                )

    return run


def _without_repeats(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Leave out rows that repeat cell, id and vector of the row before, in a partition sorted by them."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, names = batch.column("cell").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False)
        x = _vectors(batch.column("vector"), dim)
        same = np.zeros(len(names), bool)
        same[1:] = (cells[1:] == cells[:-1]) & (names[1:] == names[:-1])
        near = np.flatnonzero(same)
        same[near] = (x[near] == x[near - 1]).all(1)
        same[0] = last is not None and last[:2] == (cells[0], names[0]) and bool((last[2] == x[0]).all())
        last = (cells[-1], names[-1], x[-1].copy())
        yield batch.filter(pa.array(~same)) if same.any() else batch


def _search_lists(dim: int, k: int, min_cosine: float):
    schema = pa.schema([("id", pa.string()), ("other", pa.list_(pa.string())), ("cosine", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(_without_repeats(batches, dim), "cell"):
            names = group.column("id").to_numpy()
            x = _vectors(group.column("vector").combine_chunks(), dim)
            role = group.column("role").to_numpy()
            asks, targets = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            if not len(asks) or len(targets) < 1 or len(x) < 2:
                continue
            # Rows of one key stand side by side: they are no neighbours of each other, and
            # each of them may take a place, so more places are kept until the lists meet.
            repeated = np.flatnonzero(names[1:] == names[:-1]) + 1
            number = np.ones(len(x), np.int64)
            number[repeated] = 0
            number = np.cumsum(number)
            places = k * int(np.bincount(number).max())
            y, y_number = (x, number) if len(targets) == len(x) else (x[targets], number[targets])
            y_names = names if len(targets) == len(x) else names[targets]
            out_id, out_other, out_cosine = [], [], []
            step = max(16, min(2048, 16_000_000 // len(y)))
            for i in range(0, len(asks), step):
                rows = asks[i : i + step]
                likeness = x[rows] @ y.T
                # Keys are sorted, so the rows of the own key are one run of the targets.
                lo, hi = np.searchsorted(y_number, number[rows]), np.searchsorted(y_number, number[rows], "right")
                for j in range(int((hi - lo).max(initial=0))):
                    own = np.flatnonzero(lo + j < hi)
                    likeness[own, lo[own] + j] = -2
                # Everything at least as similar as the k-th, so ties are kept whole. Rows
                # with few members above the minimum need no search for their k-th.
                floor = np.full(len(rows), min_cosine - 2e-6, np.float32)
                if min_cosine > -1:
                    many = np.flatnonzero(np.count_nonzero(likeness >= floor[0], axis=1) > places)
                else:
                    many = np.arange(len(rows))
                if len(many) and len(y) > places:
                    kth = -np.partition(-likeness[many], places - 1, axis=1)[:, places - 1]
                    floor[many] = np.maximum(kth - 2e-6, floor[many])
                r, c = np.nonzero((likeness >= floor[:, None]) & (likeness > -1.5))
                if not len(r):
                    continue
                exact = np.einsum("ij,ij->i", x[rows[r]].astype(np.float64), y[c].astype(np.float64)).round(7)
                # Targets stand in the order of their keys, so the position settles equal cosines.
                order = np.lexsort((c, -exact, r))
                r, c, exact = r[order], c[order], exact[order]
                heads = np.flatnonzero(np.diff(r, prepend=-1))
                inner = np.arange(len(r)) - np.repeat(heads, np.diff(np.append(heads, len(r))))
                good = (inner < places) & (exact >= min_cosine)
                r, c, exact = r[good], c[good], exact[good]
                for s, e in zip(h := np.flatnonzero(np.diff(r, prepend=-1)), np.append(h[1:], len(r)), strict=True):
                    out_id.append(names[rows[r[s]]])
                    out_other.append(y_names[c[s:e]].tolist())
                    out_cosine.append(exact[s:e].tolist())
                if len(out_id) > 4096:
                    yield pa.RecordBatch.from_pydict({"id": out_id, "other": out_other, "cosine": out_cosine}, schema=schema)
                    out_id, out_other, out_cosine = [], [], []
            if out_id:
                yield pa.RecordBatch.from_pydict({"id": out_id, "other": out_other, "cosine": out_cosine}, schema=schema)

    return run


def valid_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, vector)`` of the usable rows.

    Left out are null keys and vectors that are null, not ``dim`` long, all zero,
    or hold a null, NaN or infinity.
    """
    v = F.col(vector)
    usable = (
        F.col(key).isNotNull()
        & (F.size(v) == dim)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("string").alias("id"), v.cast("array<float>").alias("vector"))


def direction_hash(vector: Column) -> Column:
    """A hash of the unit vector in 6 decimals, equal for vectors that differ only in their norm.

    The vector is divided by its largest value first, so that no square overflows or
    vanishes.
    """
    large = F.array_max(F.transform(vector, F.abs)).cast("double")
    # One-element arrays bind a value, so that it is not computed anew for every element.
    scaled = F.transform(F.array(large), lambda m: F.transform(vector, lambda x: x / m))[0]

    def rounded(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.rint(x / n * 1_000_000).cast("int")))[0]

    return F.xxhash64(F.transform(F.array(scaled), rounded)[0])


def similar_vectors(
    df: DataFrame,
    key: str,
    vector: str,
    dim: int,
    k: int = 5,
    min_cosine: float = -1.0,
    list_size: int = LIST_SIZE,
    sample_rows: int = SAMPLE_ROWS,
    replicas: int = REPLICAS,
    copies: float = COPIES,
    searches: float = SEARCHES,
    hot_copies: int = HOT_COPIES,
    block: int = BLOCK,
    cell_sample: int = CELL_SAMPLE,
) -> DataFrame:
    """``(id, rank, other, cosine)``: the k most similar other rows of each row.

    Equal cosines are ordered by id; cosines count to 7 decimals. ``min_cosine``
    leaves out less similar ones, which is cheaper. Unusable vectors (see
    ``valid_vectors``) take no part; repeated rows count once; two rows with one
    key and different vectors are both compared under that key. Fewer than two
    usable rows give no result.
    """
    spark = df.sparkSession
    usable = valid_vectors(df, key, vector, dim).withColumn("mark", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    rows = df.count()

    def draw(share: float) -> np.ndarray:
        picked = usable if share >= 1 else usable.where(F.col("mark") < int(share * (1 << 30)))
        arrow = picked.select("vector").toArrow()
        return _unit(_vectors(arrow.column("vector").combine_chunks(), dim)) if arrow.num_rows else np.zeros((0, dim), np.float32)

    sample = draw(min(1.0, sample_rows / max(rows, 1)))
    if rows > sample_rows and len(sample) < sample_rows // 2:
        # Many rows are unusable: count the usable ones and draw again.
        rows = usable.count()
        sample = draw(min(1.0, sample_rows / max(rows, 1)))
    if not len(sample):
        return spark.createDataFrame([], "id string, rank int, other string, cosine double")
    lists = max(1, -(-rows // list_size))
    # Two levels at the driver while the sample gives each list at least half of what it is fitted on.
    supported = max(1, len(sample) // PER_CENTROID)
    coarse = lists if lists <= 2 * supported else supported
    graph = fit_graph(sample, coarse)
    if lists > coarse:
        share = min(1.0, PER_CENTROID * lists / rows)
        graph = Graph(graph.centres, _fine_centroids(usable, graph, sample, dim, lists, share, cell_sample))
    # Some hundred vectors for every entry point.
    wanted = max(20_000, 256 * len(graph.entries))
    ids, likeness = graph.search(sample[:: max(1, len(sample) // wanted)], replicas)
    place = Placement(graph, dim, replicas, *(fit_ratios(graph, ids, likeness, n) for n in (copies, searches)))
    del sample, ids, likeness

    counted = usable.withColumn("copy", direction_hash(F.col("vector")))
    hot = counted.groupBy("copy").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper")).where(F.col("n") > hot_copies)
    hot_rows = hot.orderBy(F.desc("n"), "copy").limit(HOT_DIRECTIONS).select("copy", "keeper").collect()
    entering = usable
    if hot_rows:
        # At most HOT_DIRECTIONS rows.
        keepers = F.broadcast(spark.createDataFrame(hot_rows, "copy long, keeper string"))
        marked = counted.join(keepers, "copy", "left")
        entering = marked.where("keeper is null or keeper = id").select("id", "mark", "vector")
    # One number per list, as many as there are centroids.
    members = arrow_map(entering.select("vector"), _count_members(place), "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(graph.centres), np.int64)
    counts[members.column("list").to_numpy()] = members.column("n").to_numpy()
    place.cut(counts, block)
    placed = arrow_map(entering, _assign(place), "cell long, role byte, id string, vector array<float>")
    listed = placed.repartition("cell").sortWithinPartitions("cell", "id", "vector")
    answers = arrow_map(listed, _search_lists(dim, k, min_cosine), "id string, other array<string>, cosine array<double>")
    if not hot_rows:
        return _best_of_lists(answers, k)
    flat = answers.select("id", F.explode(F.arrays_zip("other", "cosine")).alias("m")).select("id", "m.other", "m.cosine")
    best = _expand_hot(flat, counted, keepers, k, min_cosine)
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "other", "cosine")


def _best_of_lists(answers: DataFrame, k: int) -> DataFrame:
    """The best k of the answers that the lists of a vector gave.

    A vector searches a bounded number of lists and each gives at most k answers, so
    they meet as one short array per vector; no row per pair is shuffled.
    """
    pairs = F.arrays_zip(F.transform("cosine", lambda c: -c).alias("away"), F.col("other").alias("other"))
    met = answers.select("id", F.transform(pairs, lambda x: F.struct(x["away"].alias("away"), x["other"].alias("other"))).alias("m")).groupBy("id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("m")))).alias("m")
    )
    names = met.select("id", F.filter("m", lambda x: x["other"] != F.col("id")).alias("m"))
    names = names.select("id", "m", F.transform("m", lambda x: x["other"]).alias("o"))
    once = F.filter("m", lambda x, i: F.array_position("o", x["other"]) == i + 1)
    return names.select("id", F.posexplode(F.slice(once, 1, k)).alias("at", "m")).select(
        "id", (F.col("at") + 1).alias("rank"), F.col("m.other").alias("other"), (-F.col("m.away")).alias("cosine")
    )


def _expand_hot(answers: DataFrame, counted: DataFrame, keepers: DataFrame, k: int, min_cosine: float) -> DataFrame:
    """``(id, other, cosine)`` with the copies of hot directions in place of their keepers.

    A copy's nearest are the other copies with the smallest ids, so k+1 of them
    answer for the whole group; the same few stand for it among the neighbours of
    other vectors. What is looked up is bounded by the number of hot directions, so
    the copies themselves, which may be a large share of all rows, are not shuffled
    by their direction.
    """
    members = counted.join(keepers, "copy").select("keeper", "id")
    # Ids with their direction spread the copies; the first few of each part meet again.
    ranked = Window.partitionBy("keeper").orderBy("id")
    part = Window.partitionBy("keeper", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
    first = (
        members.groupBy("keeper", "id").agg(F.lit(1).alias("one"))
        .withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
        .withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
        .select("keeper", F.col("id").alias("member"))
    )
    # At most (k + 1) rows for each hot direction.
    first = F.broadcast(first)
    others = answers.join(first, answers["other"] == first["keeper"], "left").select(
        "id", F.coalesce("member", "other").alias("other"), "cosine"
    )
    others = others.where("id <> other").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    names = keepers.select(F.col("keeper").alias("hot"))
    cold = others.join(names, others["id"] == names["hot"], "left_anti")
    # At most k answers for each hot direction.
    of_keeper = others.join(names, others["id"] == names["hot"], "left_semi").withColumn(
        "n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    ).where(F.col("n") <= k).select(F.col("id").alias("keeper"), "other", "cosine")
    around = members.join(F.broadcast(of_keeper), "keeper").select("id", "other", "cosine")
    between = members.join(first, "keeper").select("id", F.col("member").alias("other"), F.lit(1.0).alias("cosine"))
    mine = around.unionByName(between.where(F.lit(min_cosine) <= 1.0)).where("id <> other")
    return cold.unionByName(mine).groupBy("id", "other").agg(F.max("cosine").alias("cosine"))


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """Pairs ``(chunk_a, chunk_b)``, chunk_a < chunk_b, where each is a neighbour of the other."""
    pair = neighbours.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b"))
    return pair.groupBy("chunk_a", "chunk_b").count().where("count = 2").select("chunk_a", "chunk_b")


#: Length of the project's dense vectors, and neighbours wanted of each.
DIM, NEIGHBOURS = 64, 5


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with cosine of at least 0.90 that are among the 5 most similar of each other."""
    near = similar_vectors(table(spark, sf_dir, "index_entries"), "chunk_id", "dense_vector", DIM, NEIGHBOURS, min_cosine=0.9)
    return mutual_pairs(near)


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar entries of every entry."""
    near = similar_vectors(table(spark, sf_dir, "index_entries"), "chunk_id", "dense_vector", DIM, NEIGHBOURS)
    return near.select(
        F.col("id").alias("chunk_id"), "rank", F.col("other").alias("neighbour_id"), F.col("cosine").cast("double").alias("cosine")
    )

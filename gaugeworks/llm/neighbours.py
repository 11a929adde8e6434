"""Most similar vectors for every vector (problem 2)."""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, ship

#: Vectors that the driver fits centroids on at most, vectors of them for each centroid at least, and so the centroids that
#: one level has at most. They bound what the driver holds and what every task receives (16,384 centroids of 64 numbers
#: and their graph: 6 MB). More lists than that are made in two levels. Every vector is indexed.
SAMPLE, EACH = 65_536, 4
MAX_CENTROIDS = SAMPLE // EACH
#: Sampled vectors for each list of a cell, where there are two levels.
CELL_EACH = 16
#: A list of more than this many times its intended rows is searched in tiles.
DENSE = 8
#: Cosine that the 16-bit codes may be off by at most; what they leave open is decided by the vectors themselves.
ERROR = 4e-5
#: Neighbours kept beyond k until that is decided.
SPARE = 6
#: Up to so many centroids a product with all of them is cheaper than a walk over their graph.
FEW = 512
#: Placed rows for each task that searches lists.
PARTITION_ROWS = 32_000
_SCALE = 32767.0


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Hierarchical balanced clustering on unit vectors: clusters are split in up to 16 until each holds its share."""
    rng = np.random.default_rng(seed)
    leaf = max(1.0, len(x) / lists)
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        k = min(16, round(len(own) / leaf))
        if k < 2:
            out.append(x[own].mean(0))
            continue
        pts = x[own]
        c = pts[rng.choice(len(own), k, replace=False)]
        size = np.full(k, len(own) / k)
        for _ in range(8):
            sim = pts @ c.T
            spread = max(1e-6, float(sim.max(1).std()))
            at = np.argmax(sim - spread * (size * k / len(own) - 1), axis=1)  # large clusters are made less attractive
            size = 0.5 * size + 0.5 * np.bincount(at, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, at, pts)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), pts[rng.choice(len(own), k)])
        at = np.argmax(pts @ c.T - spread * (size * k / len(own) - 1), axis=1)
        if np.bincount(at, minlength=k).max() == len(own):  # all alike: no split
            out.append(pts.mean(0))
            continue
        todo += [own[at == j] for j in range(k) if (at == j).any()]
    c = np.asarray(out, dtype=np.float32)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


class CentroidGraph:
    """Centroids with a neighbour graph in memory. search() walks it for a batch of queries at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, seed: int = 0):
        self.c = np.ascontiguousarray(centroids, dtype=np.float32)
        n = len(self.c)
        if n <= FEW:
            return
        degree = min(degree, n - 1)
        # where walks start: the centroids nearest to the centres of about 2 sqrt(n) clusters of centroids
        middle = balanced_centroids(self.c, max(1, 2 * int(n**0.5)), seed)
        self.pivots = np.unique(np.argmax(middle @ self.c.T, axis=1)).astype(np.int32)
        rows = []
        for at in range(0, n, 2048):
            sim = self.c[at : at + 2048] @ self.c.T
            sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -2
            near = np.argpartition(-sim, degree - 1, axis=1)[:, :degree] if degree else np.zeros((len(sim), 0), dtype=np.int64)
            rows.append(near.astype(np.int32))
        near = np.concatenate(rows)
        # edges lead back too, as far as there is room: a centroid that is no one's neighbour must be found
        back: list[list[int]] = [[] for _ in range(n)]
        for a, row in enumerate(near):
            for b in row:
                if len(back[b]) < degree:
                    back[b].append(a)
        self.edges = np.tile(np.arange(n, dtype=np.int32)[:, None], (1, 2 * degree))  # padded with the node itself
        self.edges[:, :degree] = near
        for a, own in enumerate(back):
            own = [b for b in own if b not in set(near[a].tolist())]
            self.edges[a, degree : degree + len(own)] = own

    def search(self, q: np.ndarray, k: int, width: int = 24, steps: int = 6, wide: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each query by the graph and their similarities, best first."""
        n = len(self.c)
        steps = max(steps, -(-k // wide) + 2)
        k, width = min(k, n), min(max(width, k), n)
        if n <= max(FEW, 4 * width):  # the walk would see all of them
            ids = np.broadcast_to(np.arange(n, dtype=np.int32), (len(q), n))
            sim = q @ self.c.T
        else:
            start = q @ self.c[self.pivots].T
            first = min(8, len(self.pivots))
            ids = self.pivots[np.argpartition(-start, first - 1, axis=1)[:, :first]]
            sim = np.einsum("qd,qkd->qk", q, self.c[ids])
            done = np.zeros(ids.shape, dtype=bool)
            rows = np.arange(len(q))[:, None]
            for _ in range(steps):
                go = np.argpartition(np.where(done, 2.0, -sim), min(wide, ids.shape[1]) - 1, axis=1)[:, :wide]
                if done[rows, go].all():
                    break
                done[rows, go] = True
                new = self.edges[ids[rows, go]].reshape(len(q), -1)
                new_sim = np.einsum("qd,qkd->qk", q, self.c[new])
                ids, sim = np.concatenate([ids, new], 1), np.concatenate([sim, new_sim], 1)
                done = np.concatenate([done, np.zeros(new.shape, dtype=bool)], 1)
                order = np.argsort(ids * 2 - done, axis=1, kind="stable")  # of equal ids the expanded one is first
                ids, sim, done = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(done, order, 1)
                again = np.zeros(ids.shape, dtype=bool)
                again[:, 1:] = ids[:, 1:] == ids[:, :-1]
                sim = np.where(again, -3.0, sim)
                done |= again
                if ids.shape[1] > width:
                    best = np.argpartition(-sim, width - 1, axis=1)[:, :width]
                    ids, sim, done = np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1), np.take_along_axis(done, best, 1)
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1)

    def lists(self, x: np.ndarray, members: int, probes: int, member_ratio: float, probe_ratio: float, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For unit vectors: nearest lists, which of them the vector belongs to and which it is to search.

        A vector belongs to its nearest list and, near a boundary, to further ones (distance within member_ratio of the
        least), save those whose distance to a list it already has is under `spread` times their distance to the vector.
        It searches the lists within probe_ratio of the least distance.
        """
        ids, sim = self.search(x, max(members, probes))
        dist = np.sqrt(np.maximum(2 - 2 * sim, 1e-12))
        member = dist <= member_ratio * dist[:, :1]
        member[:, members:] = False
        for j in range(1, min(members, ids.shape[1])):
            for i in range(j):
                apart = np.sqrt(np.maximum(2 - 2 * np.einsum("qd,qd->q", self.c[ids[:, j]], self.c[ids[:, i]]), 1e-12))
                member[:, j] &= ~(member[:, i] & (apart < spread * dist[:, j]))
        probe = dist <= probe_ratio * dist[:, :1]
        probe[:, probes:] = False
        return ids, member, probe


def _numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are usable vectors, and these as float64."""
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    flat = column.take(pa.array(at)).flatten()
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[fine], x[fine]


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a contiguous matrix as binary values, without a copy for each."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(codes, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), dtype=np.int16).reshape(-1, dim)


def _encode(dim: int):
    """Usable vectors as 16-bit numbers scaled to the largest one: cosine does not depend on scale, and loses about 1e-5."""

    def run(batches):
        for b in batches:
            at, x = _numbers(b.column(1), dim)
            code = np.rint(x / np.abs(x).max(1, keepdims=True) * _SCALE).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _binary(code)], names=["item", "code"])

    return run


def _unit(code: np.ndarray) -> np.ndarray:
    x = code.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Lists:
    """Posting lists: their centroids, and into how many tiles of members and of searchers each is cut.

    Sizes are estimated from placed sample vectors; tiles only bound a task's work and memory. A vector belongs to one
    part of a list's members and searches all of them, so that the result is the same however a list is cut.
    """

    def __init__(self, centroids: np.ndarray, settings: dict, sample: np.ndarray, scale: float, asking: float, list_rows: int, seed: int = 0):
        self.graph, self.settings = CentroidGraph(centroids, seed=seed), settings
        size, asks = np.zeros(len(centroids)), np.zeros(len(centroids))
        for at in range(0, len(sample), 2048):
            ids, member, probe = self.graph.lists(sample[at : at + 2048], **settings)
            size += np.bincount(ids[member], minlength=len(size))
            asks += np.bincount(ids[probe], minlength=len(asks))
        self.size, self.asks = size * scale, asks * scale * asking
        self.parts = np.maximum(1, np.ceil(self.size / (DENSE * list_rows))).astype(np.int64)
        self.turns = np.maximum(1, np.ceil(self.asks / (DENSE * list_rows))).astype(np.int64)

    def place(self, item: np.ndarray, code: np.ndarray, belongs: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(list, tile, role, row): one entry for each list and tile that a vector belongs to or searches; role 1 belongs, 2
        searches, 3 both."""
        found = []
        for own, settings in ((np.flatnonzero(asks), self.settings), (np.flatnonzero(~asks), self.settings | {"probes": 1})):  # who asks nothing needs few lists
            if len(own):
                ids, member, probe = self.graph.lists(_unit(code[own]), **settings)
                role = (member & belongs[own, None]) + 2 * (probe & asks[own, None])
                row, c = np.nonzero(role)
                found.append((ids[row, c].astype(np.int64), role[row, c], own[row]))
        at, role, row = (np.concatenate(x) for x in zip(*found))
        parts, turns = self.parts[at], self.turns[at]
        dense = parts * turns > 1
        if not dense.any():
            return at, np.zeros(len(at), np.int64), role, row
        out = [(at[~dense], np.zeros((~dense).sum(), np.int64), role[~dense], row[~dense])]
        luck = (item[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
        for bit, copies, tile in ((1, turns, lambda own, k: luck[own] % parts[own] * turns[own] + k), (2, parts, lambda own, k: k * turns[own] + luck[own] % turns[own])):
            of = np.flatnonzero(dense & (role & bit > 0))
            n = copies[of]
            own = np.repeat(of, n)
            out.append((at[own], tile(own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)), np.full(len(own), bit), row[own]))
        return tuple(np.concatenate(x) for x in zip(*out))


_PLACED = "list long, tile long, role byte, item bigint, code binary"


def _placed(lists: Lists, base: int, item: np.ndarray, code: np.ndarray, belongs: np.ndarray, asks: np.ndarray, step: int = 2048):
    for at in range(0, len(item), step):
        own, codes = item[at : at + step], code[at : at + step]
        where, tile, role, row = lists.place(own, codes, belongs[at : at + step], asks[at : at + step])
        yield pa.RecordBatch.from_arrays([pa.array(where + base), pa.array(tile), pa.array(role.astype(np.int8)), pa.array(own[row]), _binary(codes[row])], names=["list", "tile", "role", "item", "code"])


def _place(lists: Lists, dim: int):
    """(item, code, asks) to one row for each list and tile that an item belongs to or searches."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from _placed(lists, 0, b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1).to_pylist(), dim), np.ones(b.num_rows, bool), b.column(2).to_numpy(zero_copy_only=False))

    return run


def _fit_cell(dim: int, settings: dict, scale: float, asking: float, list_rows: int, seed: int):
    """The sampled members of a cell to its posting lists, pickled."""

    def run(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table.column("code").to_pylist(), dim))
        lists = Lists(balanced_centroids(x, max(1, len(x) // CELL_EACH), seed), settings, x, scale, asking, list_rows, seed)
        return pa.table({"list": table.column("list").slice(0, 1), "lists": pa.array([pickle.dumps((lists.graph.c, lists.parts, lists.turns))], pa.binary())})

    return run


def _place_in_cells(dim: int, settings: dict, seed: int):
    """Rows sorted by cell and copy: a cell's lists (role null), then the vectors that are placed in them."""

    def run(batches):
        lists, cell = None, -1
        for b in batches:
            new = np.flatnonzero(np.asarray(b.column("role").is_null()))
            at = 0
            for cut in [*new.tolist(), b.num_rows]:
                part = b.slice(at, cut - at)
                if part.num_rows and lists is not None:
                    role, code = part.column("role").to_numpy(zero_copy_only=False).astype(np.int64), _matrix(part.column("code").to_pylist(), dim)
                    yield from _placed(lists, cell << 24, part.column("item").to_numpy(zero_copy_only=False), code, role & 1 > 0, role & 2 > 0)
                if cut < b.num_rows:
                    c, parts, turns = pickle.loads(b.column("code")[cut].as_py())
                    lists, cell = Lists.__new__(Lists), b.column("list")[cut].as_py()
                    lists.graph, lists.settings, lists.parts, lists.turns = CentroidGraph(c, seed=seed), settings, parts, turns
                at = cut + 1

    return run


def _in_two_levels(reps: DataFrame, cells: Lists, lists: int, n: int, asking: float, dim: int, settings: dict, list_rows: int, seed: int) -> DataFrame:
    """Placed rows where there are more lists than one level has: vectors go to cells, each cell is fitted on a sample of its
    own members, and its lists then stream ahead of the cell's vectors. No task holds more than the lists of one cell."""
    placed = reps.mapInArrow(_place(cells, dim), _PLACED).filter("tile = 0 or role = 1").groupBy("list", "item").agg(F.max("code").alias("code"), F.bit_or("role").alias("role"))
    placed = save(placed, "cells")
    share = CELL_EACH * lists / n
    bits = 1 << 30
    sample = placed.filter((F.col("role").bitwiseAND(1) > 0) & (F.pmod(F.xxhash64("item", F.lit(seed + 1)), F.lit(bits)) < int(bits * min(1.0, share)))).select("list", "code")
    fitted = save(sample.groupBy("list").applyInArrow(_fit_cell(dim, settings, 1 / min(1.0, share), asking, list_rows, seed), "list long, lists binary"), "cell-lists")
    copies = max(1, round(4 * n / len(cells.size) / 500_000))
    heads = fitted.select("list", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(None).cast("byte").alias("role"), F.lit(None).cast("long").alias("item"), F.col("lists").alias("code"))
    rows = placed.select("list", F.pmod(F.xxhash64("item"), F.lit(copies)).cast("int").alias("copy"), F.col("role").cast("byte").alias("role"), "item", "code")
    ordered = heads.unionByName(rows).repartition(max(1, len(cells.size) * copies // 4), "list", "copy").sortWithinPartitions("list", "copy", F.asc_nulls_first("role"))
    return ordered.select("list", "role", "item", "code").mapInArrow(_place_in_cells(dim, settings, seed), _PLACED)


def nearest_in_block(qi: np.ndarray, qc: np.ndarray, pi: np.ndarray, pc: np.ndarray, k: int, least: float | None, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of the items pi to each of qi (never the item itself), as pairs with exact cosines of the codes."""
    q, p = _unit(qc), _unit(pc)
    pn = np.einsum("nd,nd->n", pc.astype(np.float64), pc)
    where = np.argsort(pi, kind="stable")
    out = ([], [], [])
    bar = -2.0 if least is None else least - 1e-5
    for at in range(0, len(q), step):
        sim = q[at : at + step] @ p.T
        spot = np.minimum(np.searchsorted(pi, qi[at : at + step], sorter=where), len(pi) - 1)
        own = where[spot]
        same = pi[own] == qi[at : at + step]
        sim[np.flatnonzero(same), own[same]] = -3.0
        if least is None and sim.shape[1] > k:
            c = np.argpartition(-sim, k - 1, axis=1)[:, :k].ravel()
            r = np.repeat(np.arange(len(sim)), k)
            keep = sim[r, c] > bar
            r, c = r[keep], c[keep]
        else:
            r, c = np.nonzero(sim >= bar if least is not None else sim > bar)
        if not len(r):
            continue
        a, b = qc[at : at + step][r].astype(np.float64), pc[c].astype(np.float64)
        cos = np.einsum("nd,nd->n", a, b) / np.sqrt(np.einsum("nd,nd->n", a, a) * pn[c])  # integers: the same whatever the order
        order = np.lexsort((pi[c], -cos, r))
        r, c, cos = r[order], c[order], cos[order]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        keep = (rank < k) & ((cos >= least) if least is not None else True)
        for box, x in zip(out, (qi[at : at + step][r[keep]], pi[c[keep]], cos[keep])):
            box.append(x)
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in out)


def _search_list(dim: int, k: int, least: float | None):
    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        item = table.column("item").to_numpy()
        code = _matrix(table.column("code").to_pylist(), dim)
        of, to = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        _, once = np.unique(item[to], return_index=True)
        to = to[once]
        a, b, cos = nearest_in_block(item[of], code[of], item[to], code[to], k, least) if len(of) and len(to) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cos, pa.float64())})

    return run


def nearest(vectors: DataFrame, k: int = 10, dim: int = 64, asks: Column | None = None, min_cosine: float | None = None, list_rows: int = 1024, members: int = 2, probes: int = 4, member_ratio: float = 1.1, probe_ratio: float = 1.2, spread: float = 0.5, seed: int = 0, max_centroids: int = MAX_CENTROIDS) -> DataFrame:
    """The k other items of highest cosine for every item (or those for which `asks` holds): (a, b, cosine, rank).

    vectors: (item bigint, feats array<float>). Null, wrong-length, all-zero, NaN or infinite vectors take no part;
    repeated rows count once; null items take no part. Ties go to the smaller item.

    Exact copies are one representative (the smallest item) from the start, so a hot group of copies is searched once; the
    copies then get the representative's result, and each other at cosine 1.

    The index is a set of balanced posting lists of about list_rows vectors, whose number follows from the number of
    vectors alone. Centroids come from hierarchical balanced clustering of a bounded sample (SAMPLE vectors by hash); more
    lists than max_centroids are made in two levels. Every vector is then placed: it belongs to its nearest list, boundary
    vectors to up to `members`, and it searches the lists within probe_ratio of its least centroid distance, at most
    `probes`. The centroids are searched by a graph in memory. Lists are the groups of one shuffle, dense ones in
    tiles; each is searched by blocked matrix products, and the results of an item's lists are merged.

    Vectors travel as 16-bit codes. Where these leave a rank or min_cosine open, and everywhere if min_cosine is not given,
    cosines are computed again from the vectors themselves.

    min_cosine: return only pairs of at least this cosine; it is applied before anything is merged, and the result is the
    same as filtering afterwards. Recall depends on probes; see the README for measured figures.
    """
    spark = vectors.sparkSession
    codes = vectors.filter("item is not null").select(F.col("item").cast("long").alias("item"), "feats").mapInArrow(_encode(dim), "item bigint, code binary")
    asked = (F.expr("true") if asks is None else asks).alias("asks")
    # copies: the smallest item stands for all of them; map-side combine keeps a hot group small
    reps = save(codes.groupBy("code").agg(F.min("item").alias("item"), F.max("item").alias("last"), F.max(F.expr("true") if asks is None else asks).alias("asks")), "vectors")
    n, n_asks = reps.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    bits = 1 << 30
    share = min(bits, int(bits * min(1.0, SAMPLE / max(1, n))))
    sample = reps.filter(F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(bits)) < share).select("code").limit(2 * SAMPLE)
    x = _unit(_matrix([bytes(r[0]) for r in sample.collect()], dim)) if n else np.zeros((0, dim), np.float32)
    if not len(x):
        return spark.createDataFrame([], "a bigint, b bigint, cosine double, rank int")
    settings = {"members": members, "probes": probes, "member_ratio": member_ratio, "probe_ratio": probe_ratio, "spread": spread}
    asking = n_asks / n
    lists = max(1, -(-n // list_rows))
    reps_in = reps.select("item", "code", "asks")
    # the driver's sample makes one level, or the cells of two
    one = lists <= min(max_centroids, max(1, len(x) // EACH)) or lists <= 1
    top = lists if one else max(2, min(max_centroids, int(lists**0.5)))
    placing = settings if one else settings | {"members": 2, "probes": 3}
    fitted = Lists(balanced_centroids(x, top, seed), placing, x, n / len(x), asking, list_rows if one else n, seed)
    if one:
        placed, groups = reps_in.mapInArrow(_place(fitted, dim), _PLACED), int((fitted.size.sum() + fitted.asks.sum()) // PARTITION_ROWS) + 1
    else:
        placed, groups = _in_two_levels(reps_in, fitted, lists, n, asking, dim, settings, list_rows, seed), 4 * n * max(members, 1) // PARTITION_ROWS + 1
    # partitions follow from the number of rows, so that a task reads as much whatever the size of the table
    found = placed.repartition(groups, "list", "tile").groupBy("list", "tile").applyInArrow(_search_list(dim, k + SPARE, None if min_cosine is None else min_cosine - ERROR), "a bigint, b bigint, cosine double")
    # at most probes x (k + SPARE) of a representative meet here
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("c"), F.col("b").alias("b")))), 1, k + SPARE)
    near = found.groupBy("a").agg(best.alias("near"))
    unsure = F.lit(True)
    if min_cosine is not None:  # a cosine near the bound, or no clear step after the k-th
        step = F.get("near", F.lit(k))["c"] - F.get("near", F.lit(k - 1))["c"]
        unsure = F.exists("near", lambda r: F.abs(r["c"] + min_cosine) <= ERROR) | F.coalesce(step <= 2 * ERROR, F.lit(False))
    near = save(near.select("a", unsure.alias("unsure"), F.inline("near")).select("a", "b", (-F.col("c")).alias("cosine"), "unsure"), "near")
    pairs = _with_copies(codes, reps, near, k, asked, asks is not None)
    open_ = pairs.filter("unsure").select("a", "b")
    if min_cosine is None or not near.filter("unsure").isEmpty():
        exact = _exact(vectors, save(open_, "open"), dim).select("a", "b", "cosine")
        pairs = pairs.filter("not unsure").select("a", "b", "cosine").unionByName(exact)
    if min_cosine is not None:
        pairs = pairs.filter(F.col("cosine") >= min_cosine)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("a", "b", "cosine", "rank")


def _cosines(dim: int):
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.float32).reshape(-1, dim).astype(np.float64) for c in ("x", "y"))
            dot = lambda p, q: np.einsum("nd,nd->n", p, q)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(np.clip(dot(x, y) / np.sqrt(dot(x, x)) / np.sqrt(dot(y, y)), -1.0, 1.0))], names=["a", "b", "cosine"])

    return run


def _floats(dim: int):
    def run(batches):
        for b in batches:
            at, x = _numbers(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _binary(x.astype(np.float32))], names=["item", "x"])

    return run


def _exact(vectors: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """(a, b, cosine) of pairs (a, b), from the vectors in 32 bits; only the vectors that some pair names travel."""
    named = pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct()
    used = vectors.filter("item is not null").select(F.col("item").cast("long").alias("item"), "feats").join(named, "item", "left_semi")
    floats = used.mapInArrow(_floats(dim), "item bigint, x binary").groupBy("item").agg(F.min("x").alias("x"))
    floats = save(floats, "floats")
    both = pairs.join(floats.select(F.col("item").alias("a"), "x"), "a").join(floats.select(F.col("item").alias("b"), F.col("x").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_cosines(dim), "a bigint, b bigint, cosine double")


def _with_copies(codes: DataFrame, reps: DataFrame, near: DataFrame, k: int, asked: Column, some: bool) -> DataFrame:
    """Neighbours of representatives to neighbours of all items: (a, b, cosine, unsure)."""
    groups = reps.filter("last > item").select(F.col("item").alias("rep"), "code")
    if groups.isEmpty():
        return near
    copies = save(codes.join(groups, "code").select("rep", "item").distinct(), "copies")
    # of each group the k + 1 smallest items can be neighbours; the limit is applied before the shuffle as well
    first = copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("item"))).filter(F.col("n") <= k + 1).select("rep", "item")
    inside = copies.select("rep", F.col("item").alias("a")).join(first.select("rep", F.col("item").alias("b")), "rep").filter("a <> b").select("a", "b", F.lit(1.0).alias("cosine"), F.lit(False).alias("unsure"))
    of = near.join(copies.select(F.col("rep").alias("a"), F.col("item").alias("_a")), "a", "left").select(F.coalesce("_a", "a").alias("a"), "b", "cosine", "unsure")
    to = of.join(first.select(F.col("rep").alias("b"), F.col("item").alias("_b")), "b", "left").select("a", F.coalesce("_b", "b").alias("b"), "cosine", "unsure")
    pairs = inside.unionByName(to)
    return pairs.withColumnRenamed("a", "item").filter(asked).withColumnRenamed("item", "a") if some else pairs


def close_pairs(vectors: DataFrame, min_cosine: float = 0.9, k: int = 10, **settings) -> DataFrame:
    """Pairs (a, b, cosine), a < b, of at least min_cosine of which one is among the k nearest of the other."""
    near = nearest(vectors, k, min_cosine=min_cosine, **settings)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


ship(sys.modules[__name__])

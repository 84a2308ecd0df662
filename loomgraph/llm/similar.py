"""Most similar vectors of every vector: a forest of hash prefixes.

Each tree gives a vector a long hash string, a bit per random hyperplane, and keeps all vectors sorted by it. A vector
descends in each tree to its longest prefix that others share, which is as long as its surroundings are dense. From
there all trees ascend in step, one bit at a time, until the vectors below the prefixes of that length are enough; these
are its candidates. A sketch of further hash bits sorts out far ones; those left are compared exactly.

A tree is cut at prefixes, longer ones where it is dense, into parts of a bounded number of rows. So no task holds a
tree, and no candidate is lost at the bounds of a part.

Where prefixes are overfull, thousands of vectors lie in a narrow cone, and which of them are nearest no hash tells.
There a ball is laid around the middle of the prefix's vectors, and its rows are compared with all rows that can be near
enough, block by block, instead of entering the forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.session import BROADCAST_BYTES, only, spread, written

DIM, TREES, BITS = 64, 16, 64
#: candidates that an ascent ends with, and rows of a part of a tree, unless its hashes are equal to the CUT_BITS-th bit
WANTED, TASK_ROWS, CUT_BITS = 512, 200_000, 16
#: vectors that a prefix of usual length holds, where overfull ones are sought
SHARED = 48
SKETCH_BITS = 16  # of each tree, from the far end of its hash string
SEED = 20_240_501
#: trees and bits that overfull prefixes are sought in; vectors of one are OVERFULL times as many as usual, and FEWEST at least
SOUGHT_TREES, SOUGHT_BITS, OVERFULL, FEWEST = 4, 14, 2, 96
#: rows that a ball's blocks have at least and at most, and into how many it is divided in between
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCKS = 8192, 131_072, 6


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, TREES * BITS)).astype(np.float32)


def _usable(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, lists = batch.column(0), batch.column(1)
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        whole = np.flatnonzero((sizes == dim) & ~np.asarray(ids.is_null()))
        taken = lists.take(pa.array(whole))
        values = taken.flatten()
        v = np.asarray(values.cast(pa.float64()).fill_null(math.nan)).reshape(-1, dim)
        ok = np.isfinite(v).all(1) & (v != 0).any(1)
        v, rows = v[ok], whole[ok]
        # equal directions up to the precision of a float share a class
        direction = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 5) + 0.0
        cls = [hashlib.md5(x.tobytes()).digest() for x in direction]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(cls, pa.binary()), _binaries(v.astype(np.float32))], names=["node_id", "cls", "vec"])


def usable_vectors(df: DataFrame, key: str = "node_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """(node_id, cls, vec): rows with exactly `dim` finite components that are not all zero; vec as floats, cls hashes the direction."""
    return spread(only(df, key, vector)).select(F.col(key).cast("bigint").alias("node_id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(lambda b: _usable(b, dim), "node_id bigint, cls binary, vec binary")


def _binaries(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of an array."""
    data, size = np.ascontiguousarray(rows), rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(data)])


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(column.buffers()[2], np.float32)[column.offset * dim :][: len(column) * dim].reshape(-1, dim)


def _hashes(v: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each vector (row) in each tree, and its sketch."""
    bits = np.packbits((v / np.abs(v).max(1, keepdims=True) @ planes) > 0, axis=1).reshape(len(v), TREES, BITS // 8)
    return np.ascontiguousarray(bits).view(">u8").reshape(len(v), TREES).astype(np.uint64), np.ascontiguousarray(bits[:, :, -SKETCH_BITS // 8 :]).reshape(len(v), -1)


def _outside(batch: pa.RecordBatch, dim: int, middles: np.ndarray, apart: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of (node_id, vec, ...) without the rows at home in a ball, and their vectors."""
    for at in range(0, batch.num_rows, 2000):
        part = batch.slice(at, 2000)
        v = _floats(part.column(1), dim)
        if len(middles):
            far = np.flatnonzero((_unit(part.column(1), dim) @ middles.T < math.cos(apart)).all(1))
            part, v = part.take(pa.array(far)), v[far]
        if len(v):
            yield part, v


class _Cuts:
    """The parts of all trees: prefixes with at most TASK_ROWS rows whose parent has more, from the counts of rows by the first `bits` bits."""

    def __init__(self, counts: np.ndarray):
        self.bits = counts.shape[1].bit_length() - 1
        part, depth = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
        levels = [counts]
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1].reshape(len(counts), -1, 2).sum(2))
        n, sizes = 0, []
        for t in range(len(counts)):
            open_ = [(len(levels) - 1, 0)]
            while open_:
                up, at = open_.pop()
                rows = int(levels[up][t, at])
                if up and rows > TASK_ROWS:
                    open_ += [(up - 1, 2 * at + 1), (up - 1, 2 * at)]
                    continue
                below = slice(at << up, (at + 1) << up)
                part[t, below], depth[t, below] = n, self.bits - up
                sizes.append(rows)
                n += 1
        self.part, self.depth = part, depth
        # parts that are small share a task
        self.task = (np.cumsum(sizes) - np.array(sizes)) // TASK_ROWS
        self.tasks = int(self.task[-1]) + 1

    def of(self, tree: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (hashes >> np.uint64(BITS - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        return self.part[tree, at], self.depth[tree, at]


def _cut_counts(batches: Iterator[pa.RecordBatch], dim: int, bits: int, middles: np.ndarray, apart: float) -> Iterator[pa.RecordBatch]:
    planes, n = _planes(dim), np.zeros(TREES << bits, np.int64)
    for batch in batches:
        for _, v in _outside(batch, dim, middles, apart):
            hashes = _hashes(v, planes)[0]
            at = (hashes >> np.uint64(BITS - bits)).astype(np.int64) if bits else np.zeros(hashes.shape, np.int64)
            n += np.bincount((at + (np.arange(TREES) << bits)).ravel(), minlength=len(n))
    held = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["prefix", "n"])


def _placed(batches: Iterator[pa.RecordBatch], dim: int, cuts: _Cuts, middles: np.ndarray, apart: float) -> Iterator[pa.RecordBatch]:
    """(task, part, depth, hash, node_id) of each tree, and of rows with a stop that and the sketch too."""
    planes = _planes(dim)
    for batch in batches:
        for rows, v in _outside(batch, dim, middles, apart):
            hashes, far = _hashes(v, planes)
            sketch = _binaries(far) if rows.num_columns > 2 else None
            for t in range(TREES):
                part, depth = cuts.of(t, hashes[:, t])
                signed = (hashes[:, t] ^ np.uint64(1 << 63)).view(np.int64)  # sorts like the bit string
                columns = [pa.array(cuts.task[part].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(depth.astype(np.int32)), pa.array(signed), rows.column(0)]
                names = ["task", "part", "depth", "hash", "node_id"]
                if sketch is not None:
                    columns, names = [*columns, rows.column(2), sketch], [*names, "stop", "sketch"]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one part each, of rows sorted by part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.asarray(batch.column(1))
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(1)[0].as_py() != part[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _sorted_array(part: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes, node ids and the depth of a part."""
    return np.asarray(part["hash"]).view(np.uint64) ^ np.uint64(1 << 63), np.asarray(part["node_id"]), part["depth"][0].as_py()


#: numbers of others that a descent notes the longest shared prefix of
NOTED = 1 << np.arange(8)


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node_id, noted): a byte for each number in NOTED: 1 + the longest prefix that so many others share in this tree, 0 if none does."""
    for part in _parts(batches):
        h, node, depth = _sorted_array(part)
        differ = h[1:] ^ h[:-1]
        noted = np.zeros((len(h), len(NOTED)), np.uint8)
        reached = np.zeros(len(h), np.int64)  # numbers noted so far
        for length in range(BITS, depth - 1, -1):
            new = (differ >> np.uint64(BITS - length)) != 0 if length else np.zeros(len(differ), bool)
            segment = np.concatenate([[0], np.cumsum(new)])
            others = np.bincount(segment)[segment] - 1
            now = np.searchsorted(NOTED, others, side="right")
            for i in np.unique(now):
                rows = (now == i) & (reached < i)
                if rows.any():
                    for k in range(i):
                        fresh = rows & (reached <= k)
                        noted[fresh, k] = length + 1
                    reached[rows] = i
            if (reached == len(NOTED)).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.ascontiguousarray(noted).view(np.int64).ravel())], names=["node_id", "noted"])


def _ascents(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """(node_id, stop): the length at which the trees, ascending in step, hold `wanted` candidates in all (numbers in between those noted count as the lower one)."""
    more = np.diff(NOTED, prepend=0)
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
        noted = np.asarray(lists.flatten()).view(np.uint8).reshape(-1, len(NOTED))
        found = np.zeros((batch.num_rows, BITS + 2), np.int64)
        for k, n in enumerate(more):
            np.add.at(found, (row, noted[:, k]), n)
        found[:, 0] = 0
        enough = found[:, ::-1].cumsum(1)[:, ::-1] >= wanted
        stop = np.where(enough.any(1), BITS + 1 - enough[:, ::-1].argmax(1) - 1, 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.maximum(stop, 0).astype(np.int32))], names=["node_id", "stop"])


def _ascended(batches: Iterator[pa.RecordBatch], most_apart: int, at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs of a vector and those that share its prefix of the length it stops at, if their sketches are near."""
    width = TREES * SKETCH_BITS // 64
    for part in _parts(batches):
        h, node, depth = _sorted_array(part)
        sketch = part["sketch"].combine_chunks()
        far = np.frombuffer(sketch.buffers()[2], np.uint64)[sketch.offset * width :][: len(h) * width].reshape(-1, width)
        stop = np.maximum(np.asarray(part["stop"]), depth).astype(np.uint64)
        below = np.where(stop == 0, np.uint64(2**64 - 1), (np.uint64(1) << (np.uint64(BITS) - np.maximum(stop, np.uint64(1)))) - np.uint64(1))
        first, last = np.searchsorted(h, h & ~below), np.searchsorted(h, h | below, side="right")
        ends = np.cumsum(last - first)
        i = 0
        while i < len(h):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, side="right")))
            size = (last - first)[i:j]
            x = np.repeat(np.arange(i, j), size)
            y = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[i:j], size)
            near = (x != y) & (np.bitwise_count(far[x] ^ far[y]).sum(1) <= most_apart)
            x, y = x[near], y[near]
            met = np.unique(np.minimum(x, y) * len(h) + np.maximum(x, y))
            a, b = node[met // len(h)], node[met % len(h)]
            other = a != b
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[other]), pa.array(np.maximum(a, b)[other])], names=["a", "b"])
            i = j


def _forest(kept: DataFrame, rows: int, dim: int, most_apart: int, middles: np.ndarray, apart: float, wanted: int) -> DataFrame:
    """(a, b): distinct candidate pairs, a < b, among the rows of kept (node_id, vec) that are at home in no ball."""
    vectors = kept.select("node_id", "vec")
    bits = min(CUT_BITS, max(0, math.ceil(math.log2(max(rows, 1) / TASK_ROWS)) + 6)) if rows > TASK_ROWS else 0
    counted = vectors.mapInArrow(lambda b: _cut_counts(b, dim, bits, middles, apart), "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(TREES << bits, np.int64)
    counts[np.asarray(counted["prefix"])] = np.asarray(counted["n"])
    cuts = _Cuts(counts.reshape(TREES, -1))
    place = "task int, part int, depth int, hash bigint, node_id bigint"
    arrays = lambda df: df.repartitionById(cuts.tasks, "task").sortWithinPartitions("part", "hash", "node_id")
    trees = vectors.mapInArrow(lambda b: _placed(b, dim, cuts, middles, apart), place)
    noted = arrays(trees).mapInArrow(_descended, "node_id bigint, noted bigint").groupBy("node_id").agg(F.collect_list("noted").alias("noted"))  # one of each tree
    stops = noted.mapInArrow(lambda b: _ascents(b, wanted), "node_id bigint, stop int")
    again = vectors.join(stops, "node_id").select("node_id", "vec", "stop").mapInArrow(lambda b: _placed(b, dim, cuts, middles, apart), f"{place}, stop int, sketch binary")
    return arrays(again).mapInArrow(lambda b: _ascended(b, most_apart), "a bigint, b bigint").distinct()


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    v = _floats(column, dim).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _prefixes(v: np.ndarray, planes: np.ndarray, level: int) -> np.ndarray:
    """A number for each vector (row) and tree sought in: the tree and the first `level` bits."""
    bits = ((v @ planes) > 0).reshape(len(v), SOUGHT_TREES, level)
    return bits @ (1 << np.arange(level, dtype=np.int64)) + (np.arange(SOUGHT_TREES) << level)


def _sought_planes(dim: int, level: int) -> np.ndarray:
    return np.ascontiguousarray(_planes(dim).reshape(dim, TREES, BITS)[:, :SOUGHT_TREES, :level]).reshape(dim, -1)


def _prefix_counts(batches: Iterator[pa.RecordBatch], dim: int, level: int) -> Iterator[pa.RecordBatch]:
    planes, n = _sought_planes(dim, level), np.zeros(SOUGHT_TREES << level, np.int64)
    for batch in batches:
        if batch.num_rows:
            n += np.bincount(_prefixes(_unit(batch.column(1), dim), planes, level).ravel(), minlength=len(n))
    held = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["prefix", "n"])


def _prefix_sums(batches: Iterator[pa.RecordBatch], dim: int, level: int, overfull: np.ndarray) -> Iterator[pa.RecordBatch]:
    planes, sums = _sought_planes(dim, level), np.zeros((len(overfull), dim))
    for batch in batches:
        if batch.num_rows:
            v = _unit(batch.column(1), dim)
            for prefix in _prefixes(v, planes, level).T:
                at = np.searchsorted(overfull, prefix)
                of = np.flatnonzero(overfull[np.minimum(at, len(overfull) - 1)] == prefix)
                np.add.at(sums, at[of], v[of])
    yield pa.RecordBatch.from_arrays([pa.array(overfull), pa.array(list(sums), pa.list_(pa.float64()))], names=["prefix", "total"])


def _middles(kept: DataFrame, n: int, dim: int, level: int, apart: float) -> np.ndarray:
    """Unit vectors (rows) amid the vectors of overfull prefixes, fullest first, none within the angle `apart` of another."""
    level = min(level, SOUGHT_BITS)
    vectors = kept.select("node_id", "vec")
    counts = vectors.mapInArrow(lambda b: _prefix_counts(b, dim, level), "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    full = {r.prefix: r.n for r in counts.filter(F.col("n") >= max(FEWEST, OVERFULL * n / 2**level)).collect()}
    found = np.zeros((0, dim))
    if not full:
        return found
    overfull = np.array(sorted(full))
    sums = vectors.mapInArrow(lambda b: _prefix_sums(b, dim, level, overfull), "prefix bigint, total array<double>").groupBy("prefix").agg(*(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)))
    for r in sorted(sums.collect(), key=lambda r: (-full[r[0]], r[0])):
        middle = np.array(r[1:])
        if (length := np.linalg.norm(middle)) and (found @ (middle / length) < math.cos(apart)).all():
            found = np.vstack([found, middle / length])
    return found


def _balls(batches: Iterator[pa.RecordBatch], dim: int, middles: np.ndarray, apart: float) -> Iterator[pa.RecordBatch]:
    """(node_id, vec, ball, home): a row within `apart` of a middle is at home in the nearest one's ball, and a guest in any other whose rows at home can be within `apart` of it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            cos = _unit(part.column(1), dim) @ middles.T
            near = cos >= math.cos(min(math.pi, 2 * apart)) - 1e-9
            best = cos.argmax(1)
            inside = cos[np.arange(len(cos)), best] >= math.cos(apart)
            row, ball = np.nonzero(near)
            if len(row):
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ball.astype(np.int32)), pa.array(inside[row] & (best[row] == ball))], names=["node_id", "vec", "ball", "home"])


class _Nearest:
    """The k nearest of each row of a block, among rows that come by ascending id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, least: float):
        self.ids, self.v, self.v32, self.k = ids, v, v.astype(np.float32), k
        self.near, self.cos = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), least - 1e-6)

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        at, step = 0, 64  # few at first, as the first ones pass unless they are below `least`
        while at < len(ids):
            self._add(ids[at : at + step], v[at : at + step])
            at, step = at + step, min(2 * step, 1024)

    def _add(self, ids: np.ndarray, v: np.ndarray) -> None:
        v32 = v.astype(np.float32)
        for lo in range(0, len(self.ids), 2048):
            hi = lo + 2048
            # a later id must be better by 1e-6, and no cosine is above 1; floats are off by less than 5e-7
            worst = self.cos[lo:hi, -1]
            least = np.where(worst >= 1 - 1e-9, 2, worst).astype(np.float32)
            x, y = np.nonzero(self.v32[lo:hi] @ v32.T >= least[:, None])
            x += lo
            other = self.ids[x] != ids[y]
            x, y = x[other], y[other]
            if not len(x):
                continue
            cos = np.round(np.einsum("ij,ij->i", self.v[x], v[y]), 6)
            rows = np.unique(x)
            r = np.concatenate([np.repeat(rows, self.k), x])
            c, i = np.concatenate([self.cos[rows].ravel(), cos]), np.concatenate([self.near[rows].ravel(), ids[y]])
            order = np.lexsort((i, -c, r))
            r, c, i = r[order], c[order], i[order]
            first = np.searchsorted(r, rows)
            take = first[:, None] + np.arange(self.k)
            self.cos[rows], self.near[rows] = c[take], i[take]

    def result(self, least: float) -> pa.RecordBatch:
        x, at = np.nonzero((self.near >= 0) & (self.cos >= least))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[x]), pa.array(self.near[x, at]), pa.array(self.cos[x, at])], names=["x", "y", "similarity"])


def _in_blocks(batches: Iterator[pa.RecordBatch], dim: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows by (ball, block, role, node_id): those of role 0 are the block's own, and are compared with those of role 1."""
    key, ids, own, nearest = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)) for c in (0, 1, 2)], 1).astype(np.int64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if key != (now := tuple(keys[lo, :2])):
                if nearest:
                    yield nearest.result(least)
                key, ids, own, nearest = now, [], [], None
            part = batch.slice(lo, hi - lo)
            i, v = np.asarray(part.column(3)), _unit(part.column(4), dim)
            if keys[lo, 2] == 0:
                ids.append(i)
                own.append(v)
                continue
            if nearest is None:
                nearest = _Nearest(np.concatenate(ids or [i[:0]]), np.concatenate(own or [v[:0]]), k, least)
            nearest.add(i, v)
    if nearest:
        yield nearest.result(least)


def _dense(kept: DataFrame, n: int, k: int, least: float, dim: int, level: int) -> tuple[DataFrame | None, np.ndarray]:
    """(x, y, similarity): the k nearest y of each x where x or y lies in a dense ball, None if there is none; and the middles of the balls.

    Rows at home are compared with all rows that can be as near as `least`, so these are all pairs that count.
    """
    apart = math.acos(least)
    middles = _middles(kept, n, dim, level, apart)
    if not len(middles):
        return None, middles
    vectors = kept.select("node_id", "vec")
    laid = lambda m: vectors.mapInArrow(lambda b: _balls(b, dim, m, apart), "node_id bigint, vec binary, ball int, home boolean")
    homes = {r.ball for r in laid(middles).filter("home").groupBy("ball").count().filter(F.col("count") >= FEWEST).collect()}
    if not homes:
        return None, middles[:0]
    middles = middles[sorted(homes)]
    balls = laid(middles)
    sizes: dict[int, list[int]] = {}
    for r in balls.groupBy("ball", "home").count().collect():
        sizes.setdefault(r.ball, [0, 0])[0 if r.home else 1] = r["count"]
    blocks = lambda m: max(min(BLOCKS, -(-m // BLOCK_ROWS)), -(-m // MOST_BLOCK_ROWS))
    plan = [(ball, blocks(h), blocks(g)) for ball, (h, g) in sizes.items()]
    counts = kept.sparkSession.createDataFrame(plan, "ball int, own int, visiting int")
    placed = balls.join(F.broadcast(counts), "ball")
    by = lambda at, blocks: F.pmod(F.xxhash64("node_id"), blocks).cast("int") + at
    block, role = lambda i: F.array(F.struct(i.alias("block"), F.lit(0).alias("role"))), lambda i: F.struct(i.alias("block"), F.lit(1).alias("role"))
    until = lambda at, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: role(i + at))).otherwise(F.array().cast("array<struct<block:int,role:int>>"))
    own, visiting = F.col("own"), F.col("visiting")
    # blocks of rows at home meet all rows, those of guests the rows at home
    at_home = F.concat(block(by(F.lit(0), own)), until(F.lit(0), own), until(own, visiting))
    as_guest = F.concat(block(by(own, visiting)), until(F.lit(0), own))
    rows = placed.select("ball", "node_id", "vec", F.explode(F.when(F.col("home"), at_home).otherwise(as_guest)).alias("p"))
    tasks = min(sum(h + g for _, h, g in plan), max(200, kept.sparkSession.sparkContext.defaultParallelism))
    sorted_rows = rows.select("ball", "p.block", "p.role", "node_id", "vec").repartition(tasks, "ball", "block").sortWithinPartitions("ball", "block", "role", "node_id")
    return sorted_rows.mapInArrow(lambda b: _in_blocks(b, dim, k, least), "x bigint, y bigint, similarity double"), middles


def _compared(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (_floats(batch.column(k), dim).astype(np.float64) for k in (2, 3))
        dot = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(dot, 6))], names=["a", "b", "similarity"])


def similar_pairs(df: DataFrame, k: int = 5, least: float = 0.85, dim: int = DIM, wanted: int = WANTED, key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """(node_id_a, node_id_b, similarity), a < b: pairs of cosine similarity `least` or more where one is among the k most similar of the other.

    Of dense balls all pairs that count are compared, which costs the square of a ball's rows. Similarity is computed in double and rounded to 6 decimals; among equals the smaller id comes first. The forest may
    miss pairs (the README has the measured recall) but adds none but those that take a missed one's place. Keys are
    taken as unique.

    Vectors that are null, of another length, not finite or all zero are in no pair. Of vectors in one direction only
    the k + 1 smallest ids enter the forest: no other can be among anyone's k most similar. Those beyond them are compared
    with these and with what these have found, as a tie reaches farther than one direction. So a group of copies costs no more than its rows, however large it is.
    """
    all_vectors = usable_vectors(df, key, vector, dim)
    by_class = W.partitionBy("cls").orderBy("node_id")
    kept = written(all_vectors.withColumn("rn", F.row_number().over(by_class)).filter(F.col("rn") <= k + 1), "vectors")
    n = df.count()
    apart = math.acos(least) / math.pi
    sketch_bits = TREES * SKETCH_BITS
    most_apart = math.floor(sketch_bits * apart + 3 * math.sqrt(sketch_bits * apart * (1 - apart)))
    level = max(0, math.floor(math.log2(max(n, 1) / SHARED)))
    dense, middles = _dense(kept, n, k, least, dim, level)
    near = _forest(kept, n, dim, most_apart, middles, math.acos(least), wanted)
    vectors = kept.select("node_id", "vec")
    both = (
        near.join(vectors.select(F.col("node_id").alias("a"), F.col("vec").alias("va")), "a")
        .join(vectors.select(F.col("node_id").alias("b"), F.col("vec").alias("vb")), "b")
        .select("a", "b", "va", "vb")
    )
    exact = both.mapInArrow(lambda b: _compared(b, dim), "a bigint, b bigint, similarity double").filter(F.col("similarity") >= least)
    directed = exact.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "similarity")
    order = W.partitionBy("x").orderBy(F.col("similarity").desc(), "y")
    found = directed.select("p.x", "p.y", "similarity")
    if dense is not None:
        found = found.unionByName(dense).groupBy("x", "y").agg(F.max("similarity").alias("similarity"))
    top = written(found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k), "nearest")
    beyond = _beyond(all_vectors, kept, top, k, least, dim)
    return (
        top.select(F.least("x", "y").alias("node_id_a"), F.greatest("x", "y").alias("node_id_b"), "similarity")
        .unionByName(beyond)
        .groupBy("node_id_a", "node_id_b").agg(F.max("similarity").alias("similarity"))
    )


def _of_late(batches: Iterator[pa.RecordBatch], dim: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Each row's k nearest of its candidates."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        sizes, near = np.asarray(lists.value_lengths()), lists.flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        x, y = np.asarray(batch.column(0))[row], np.asarray(near.field(0))
        cos = np.round(np.einsum("ij,ij->i", _unit(batch.column(1), dim)[row], _unit(near.field(1), dim)), 6)
        ok = (x != y) & (cos >= least)
        row, x, y, cos = row[ok], x[ok], y[ok], cos[ok]
        order = np.lexsort((y, -cos, row))
        row, x, y, cos = row[order], x[order], y[order], cos[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        x, y, cos = x[first], y[first], cos[first]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(cos)], names=["node_id_a", "node_id_b", "similarity"])


def _beyond(all_vectors: DataFrame, kept: DataFrame, top: DataFrame, k: int, least: float, dim: int, per_copy: int = 2000) -> DataFrame:
    """Pairs of vectors that did not enter the forest with their k nearest.

    What is nearest to such a vector is nearest to one of its direction that did enter, or is one of these: at most
    (k + 1) ** 2 candidates of a class. They are copied for every `per_copy` rows of it.
    """
    full = kept.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("last")).filter(F.col("n") == k + 1).select("cls", "last")
    heads = kept.join(full, "cls").select("cls", "node_id")
    ids = heads.unionByName(heads.join(top, heads["node_id"] == top["x"]).select("cls", F.col("y").alias("node_id"))).distinct()
    candidates = ids.join(kept.select("node_id", "vec"), "node_id").groupBy("cls").agg(F.collect_list(F.struct("node_id", "vec")).alias("near"))
    counts = all_vectors.groupBy("cls").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > k + 1).select("cls", F.ceil(F.col("rows") / per_copy).cast("int").alias("copies"))
    marks = full.join(counts, "cls")
    copies = candidates.join(counts, "cls").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("cls", "copy", "near")
    late = all_vectors.join(F.broadcast(marks) if marks.count() * 40 <= BROADCAST_BYTES else marks, "cls").filter(F.col("node_id") > F.col("last"))
    rows = late.select("node_id", "vec", "cls", F.pmod(F.xxhash64("node_id"), "copies").cast("int").alias("copy")).join(copies, ["cls", "copy"])
    return rows.select("node_id", "vec", "near").mapInArrow(lambda b: _of_late(b, dim, k, least), "node_id_a bigint, node_id_b bigint, similarity double")

"""Texts of varying length in containers of fixed capacity: conflict-constrained best fit, decreasing."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokenizer import with_token_counts
from loomgraph.session import only, spread

CAPACITY = 2048
#: documents packed together: large enough that the last containers of a group weigh little, small enough for one task
GROUP_DOCS = 8192
#: copies of a row that are listed at a time
COPIES = 10_000
PACKED = "doc_id bigint, piece int, start_token bigint, n_tokens bigint, container_id bigint"


class Bins:
    """Open bins by residual capacity. Each carries bitmaps of the duplicate clusters and of the sources it holds."""

    def __init__(self, capacity: int, enough: int | None = None):
        self.capacity = capacity
        self.enough = enough  # bins from which on space goes before conflicts
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.residuals = 0  # bit r: some bin has residual r
        self.clusters: list[int] = []
        self.sources: list[int] = []

    def place(self, size: int, cluster: int, source: int, part_sources: bool = False) -> int:
        """The tightest bin without this cluster; of equally tight ones, the first without this source.

        Residuals are visited in ascending order from `size` until one has a compatible bin; if none has, a bin is
        opened. part_sources makes an equal source a conflict too. Once there are `enough` bins, an item that fits but
        conflicts everywhere goes into the tightest bin nevertheless.
        """
        c, s = 1 << cluster, 1 << source
        above = self.residuals >> size
        r = size
        while above:
            step = (above & -above).bit_length() - 1
            r += step
            above >>= step
            fit = -1
            for at, b in enumerate(self.open[r]):
                if self.clusters[b] & c:
                    continue
                if not self.sources[b] & s:
                    fit = at
                    break
                if fit < 0 and not part_sources:
                    fit = at
            if fit >= 0:
                b = self.open[r].pop(fit)
                if not self.open[r]:
                    self.residuals &= ~(1 << r)
                return self._put(b, r - size, c, s)
            above &= ~1
        above = self.residuals >> size
        if above and self.enough is not None and len(self.clusters) >= self.enough:
            r = size + (above & -above).bit_length() - 1
            b = self.open[r].pop(0)
            if not self.open[r]:
                self.residuals &= ~(1 << r)
            return self._put(b, r - size, c, s)
        self.clusters.append(0)
        self.sources.append(0)
        return self._put(len(self.clusters) - 1, self.capacity - size, c, s)

    def _put(self, b: int, residual: int, c: int, s: int) -> int:
        self.clusters[b] |= c
        self.sources[b] |= s
        if residual:
            self.open[residual].append(b)
            self.residuals |= 1 << residual
        return b


def pack(items: list[tuple[int, int, int, str | None]], capacity: int = CAPACITY, part_sources: bool = False, slack: float | None = None) -> Iterator[tuple[int, int, int, int, int | None]]:
    """(doc, piece, start, size, bin) for items (doc, size, cluster, source), largest piece first.

    Only an item above the capacity is divided: into full containers and a rest, which is packed like an item. Clusters
    with more copies than a quarter of the bins come before all others, to be spread while bins are empty. No container
    holds two items of a cluster, unless `slack` is given: then conflicts may cost this share of the bins that the
    total size calls for, and copies beyond that share bins.
    """
    cluster_of: dict[int, int] = {}
    source_of: dict[str | None, int] = {}
    rests: list[tuple[int, int, int, int, int, str | None]] = []
    full: list[tuple[int, int, int, int]] = []
    for doc, size, cluster, source in items:
        if size == 0:
            yield doc, 0, 0, 0, None
            continue
        n_full = size // capacity
        full += [(doc, k, k * capacity, capacity) for k in range(n_full)]
        if size % capacity:
            rests.append((size % capacity, doc, n_full, n_full * capacity, cluster, source))
    least = -(-sum(x[0] for x in rests) // capacity)
    copies = Counter(x[4] for x in rests)
    rests.sort(key=lambda x: (4 * copies[x[4]] <= least, -x[0], x[1] is None, x[1] or 0))
    bins = Bins(capacity, None if slack is None else math.ceil(least * (1 + slack)))
    for size, doc, piece, start, cluster, source in rests:
        b = bins.place(size, cluster_of.setdefault(cluster, len(cluster_of)), source_of.setdefault(source, len(source_of)), part_sources)
        yield doc, piece, start, size, b
    next_full = len(bins.clusters)
    for k, (doc, piece, start, size) in enumerate(full):
        yield doc, piece, start, size, next_full + k


def _pack_group(capacity: int, part_sources: bool, slack: float | None):
    def run(group: pa.Table) -> pa.Table:
        base = group.column("pack_group")[0].as_py() << 32
        items = list(zip(*(group.column(c).to_pylist() for c in ("doc_id", "n_tokens", "cluster", "source"))))
        rows = list(pack(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, *x[1:3], x[3] is None, x[3] or "")), capacity, part_sources, slack))
        doc, piece, start, size, bin_ = zip(*rows)
        return pa.table(
            {
                "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start_token": pa.array(start, pa.int64()),
                "n_tokens": pa.array(size, pa.int64()), "container_id": pa.array([None if b is None else base + b for b in bin_], pa.int64()),
            }
        )

    return run


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, part_sources: bool = False, slack: float | None = None) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container_id): every text in containers of `capacity` tokens.

    Documents are spread by a hash over groups of about `group_docs`, as many as the corpus needs; each group is packed by
    itself, so no task holds more than a group, and only the last containers of a group stay open. Equal rows are
    counted first and then numbered, and the hash takes in the number: they are spread too, however many there are,
    and the containers don't depend on tasks.

    No container holds two texts of a duplicate cluster (equal but for case and white space); a group with more copies
    than it needs containers opens further ones, unless `slack` bounds their share. Of equally tight containers one
    without the text's source is taken. With part_sources equal sources conflict as well, which with few sources
    leaves most of the space unused.

    Texts above the capacity are divided at multiples of it. Null and empty texts have no tokens and come out with
    piece 0 and a null container. A null source is a source of its own. Equal doc_ids are packed as separate items.
    """
    n_groups = max(1, -(-docs.count() // group_docs))
    flat = F.regexp_replace(F.lower("text"), r"\s+", " ")
    items = spread(only(docs, "doc_id", "source", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.xxhash64(flat).alias("cluster"), "text")
    counted = with_token_counts(items, vocabulary).groupBy("doc_id", "source", "cluster", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    copies = F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1)
    each = blocks.select("doc_id", "source", "cluster", "n_tokens", F.explode(copies).alias("copy")).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "cluster", "source", "copy"), F.lit(n_groups))).drop("copy")
    return each.groupBy("pack_group").applyInArrow(_pack_group(capacity, part_sources, slack), PACKED)

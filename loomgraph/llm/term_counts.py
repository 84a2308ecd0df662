"""Occurrences and records of every distinct term, counted in burst tries.

Terms are routed by adaptive prefixes: where terms are dense, routes are long. A worker keeps a trie for each route and
hands it on as a subtree; matching subtrees of all workers meet in one task and are merged node by node.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.labels import normal_form
from loomgraph.session import only, spread

#: terms in a leaf before it bursts; terms in a worker's tries before they are handed on
BURST, FLUSH = 256, 400_000
#: terms that the routes are laid out by: of each task's first rows, so many; routes for each task that merges. Neither changes a result.
ROUTED_ROWS, ROUTES_PER_TASK = 2000, 8
FIELDS = {"node": ("src_column", "dst_column"), "edge_type": ("edge_type_column",)}
COUNTED = "field string, term string, occurrences bigint, records bigint"
SUBTREE = "field string, route string, terms array<string>, occurrences array<bigint>, records array<bigint>"
RARE_RECORDS, COMMON_SHARE = 3, 0.05


class _Branch:
    """An inner node: a prefix that all terms below share, children by next character, counters of the term that ends here."""

    __slots__ = ("prefix", "children", "here")

    def __init__(self, prefix: str):
        self.prefix, self.children, self.here = prefix, {}, None


def _added(a: list[int] | None, b: list[int] | None) -> list[int] | None:
    if a is None or b is None:
        return b if a is None else a
    a[0] += b[0]
    a[1] += b[1]
    return a


class BurstTrie:
    """Counters by term. Leaves are hash tables of suffixes; one that holds more than `burst` becomes a branch.

    A branch skips the prefix that all its terms have in common, so routes are as long as the terms need and no longer.
    """

    def __init__(self, burst: int = BURST):
        self.burst, self.root = burst, {}

    def add(self, term: str, occurrences: int, records: int) -> bool:
        """Whether the term is new."""
        parent, edge, node, rest = None, "", self.root, term
        while type(node) is _Branch:
            if not rest.startswith(node.prefix):
                node = self._split(node, len(commonprefix([rest, node.prefix])))
                self._hang(parent, edge, node)
            rest = rest[len(node.prefix) :]
            if not rest:
                new = node.here is None
                node.here = _added(node.here, [occurrences, records])
                return new
            parent, edge, rest = node, rest[0], rest[1:]
            node = parent.children.get(edge)
            if node is None:
                node = parent.children[edge] = {}
        counters = node.get(rest)
        if counters is not None:
            counters[0] += occurrences
            counters[1] += records
            return False
        node[rest] = [occurrences, records]
        if len(node) > self.burst:
            self._hang(parent, edge, self._burst(node))
        return True

    def merge(self, other: BurstTrie) -> None:
        """Add all counters of another trie, which is used up: subtrees that only one of the two has are hung in as they are."""
        self.root = self._merged(self.root, other.root)

    def _merged(self, a: _Branch | dict, b: _Branch | dict) -> _Branch | dict:
        if type(a) is dict and type(b) is dict:
            if len(a) < len(b):
                a, b = b, a
            for suffix, counters in b.items():
                a[suffix] = _added(a.get(suffix), counters)
            return self._burst(a) if len(a) > self.burst else a
        if type(a) is dict or type(b) is dict:
            branch, leaf = (b, a) if type(a) is dict else (a, b)
            below = BurstTrie(self.burst)
            below.root = branch
            for suffix, counters in leaf.items():
                below.add(suffix, *counters)
            return below.root
        shared = len(commonprefix([a.prefix, b.prefix]))
        a, b = (self._split(x, shared) if len(x.prefix) > shared else x for x in (a, b))
        a.here = _added(a.here, b.here)
        for c, child in b.children.items():
            own = a.children.get(c)
            a.children[c] = child if own is None else self._merged(own, child)
        return a

    def _hang(self, parent: _Branch | None, edge: str, node: _Branch) -> None:
        if parent is None:
            self.root = node
        else:
            parent.children[edge] = node

    @staticmethod
    def _split(node: _Branch, at: int) -> _Branch:
        """A branch for the first `at` characters of the prefix, with the rest of the node below."""
        upper = _Branch(node.prefix[:at])
        upper.children[node.prefix[at]] = node
        node.prefix = node.prefix[at + 1 :]
        return upper

    @staticmethod
    def _burst(leaf: dict[str, list[int]]) -> _Branch:
        branch = _Branch(commonprefix([min(leaf), max(leaf)]))
        skip = len(branch.prefix)
        for suffix, counters in leaf.items():
            rest = suffix[skip:]
            if rest:
                branch.children.setdefault(rest[0], {})[rest[1:]] = counters
            else:
                branch.here = counters
        return branch

    def items(self) -> Iterator[tuple[str, int, int]]:
        stack: list[tuple[str, object]] = [("", self.root)]
        while stack:
            route, node = stack.pop()
            if type(node) is _Branch:
                route += node.prefix
                if node.here is not None:
                    yield route, *node.here
                stack += [(route + c, child) for c, child in node.children.items()]
            else:
                for suffix, (occurrences, records) in node.items():
                    yield route + suffix, occurrences, records


class Routes:
    """Prefixes that divide all terms, longer ones where the terms they are laid out by are dense. A term's route is the longest of them that it starts with."""

    def __init__(self, terms: list[str], routes: int):
        self.known = {""}
        self._lay(sorted(set(terms)), "", max(1, len(set(terms)) // max(1, routes)))
        self.longest = max(map(len, self.known))

    def _lay(self, terms: list[str], prefix: str, most: int) -> None:
        open_ = [(terms, prefix)]
        while open_:
            terms, prefix = open_.pop()
            self.known.add(prefix)
            if len(terms) <= most:
                continue
            skip = len(commonprefix([terms[0], terms[-1]]))
            below: dict[str, list[str]] = {}
            for t in terms:
                if len(t) > skip:
                    below.setdefault(t[: skip + 1], []).append(t)
            # as a prefix of its own only where it holds a share worth a route
            open_ += [(ts, p) for p, ts in below.items() if 4 * len(ts) > most]

    def of(self, term: str) -> str:
        known = self.known
        for n in range(min(self.longest, len(term)), -1, -1):
            if term[:n] in known:
                return term[:n]
        return ""


def _batch_counts(batch: pa.RecordBatch, columns: tuple[str, ...]) -> dict[str, list[int]]:
    """(occurrences, records) of a batch's terms: a record that has held the term in an earlier column counts once."""
    found: dict[str, list[int]] = {}
    for k, c in enumerate(columns):
        for x in pc.value_counts(batch.column(c)).to_pylist():
            if x["values"] is not None:
                one = found.setdefault(x["values"], [0, 0])
                one[0] += x["counts"]
                one[1] += x["counts"]
        for j in range(k):
            same = pc.equal(batch.column(c), batch.column(columns[j]))
            for i in range(j):
                same = pc.and_kleene(same, pc.not_equal(batch.column(c), batch.column(columns[i])).fill_null(True))
            for x in pc.value_counts(batch.column(c).filter(same.fill_null(False))).to_pylist():
                found[x["values"]][1] -= x["counts"]
    return found


def _counter(fields: dict[str, tuple[str, ...]], routes: dict[str, Routes], burst: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[str, str], BurstTrie] = {}
        held = 0

        def subtrees() -> Iterator[pa.RecordBatch]:
            for (field, route), trie in tries.items():
                terms, occurrences, records = zip(*trie.items())
                one = lambda x, t: pa.array([x], t)
                numbers = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [one(field, pa.string()), one(route, pa.string()), one(terms, pa.list_(pa.string())), one(occurrences, numbers), one(records, numbers)],
                    names=["field", "route", "terms", "occurrences", "records"],
                )

        for batch in batches:
            for field, columns in fields.items():
                route_of = routes[field].of
                for term, (occurrences, records) in _batch_counts(batch, columns).items():
                    at = (field, route_of(term))
                    trie = tries.get(at)
                    if trie is None:
                        trie = tries[at] = BurstTrie(burst)
                    held += trie.add(term, occurrences, records)
            if held >= flush:
                yield from subtrees()
                tries.clear()
                held = 0
        yield from subtrees()

    return run


def _merger(burst: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, BurstTrie(burst)

        def counted() -> Iterator[pa.RecordBatch]:
            rows = list(trie.items())
            for k in range(0, len(rows), 50_000):
                term, occurrences, records = zip(*rows[k : k + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]] * len(term), pa.string()), pa.array(term, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())],
                    names=["field", "term", "occurrences", "records"],
                )

        for batch in batches:
            for field, route, terms, occurrences, records in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (field, route):
                    yield from counted()
                    at, trie = (field, route), BurstTrie(burst)
                subtree = BurstTrie(burst)
                for x in zip(terms, occurrences, records):
                    subtree.add(*x)
                trie.merge(subtree)
        yield from counted()

    return run


def _routes(labels: DataFrame, fields: dict[str, tuple[str, ...]], tasks: int) -> dict[str, Routes]:
    """Routes of each field, laid out by the distinct terms of ROUTED_ROWS rows of some tasks: at most 64 tasks, so what comes to the driver is bounded."""
    step = max(1, labels.rdd.getNumPartitions() // 64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left = ROUTED_ROWS if TaskContext.get().partitionId() % step == 0 else 0
        for batch in batches:
            if left <= 0:
                return
            part = batch.slice(0, left)
            left -= part.num_rows
            for field, columns in fields.items():
                for c in columns:
                    terms = pc.unique(part.column(c)).drop_null()
                    yield pa.RecordBatch.from_arrays([pa.array([field] * len(terms), pa.string()), terms], names=["field", "term"])

    seen: dict[str, list[str]] = {f: [] for f in fields}
    for r in labels.mapInArrow(first, "field string, term string").distinct().toArrow().to_pylist():
        seen[r["field"]].append(r["term"])
    return {f: Routes(terms, tasks * ROUTES_PER_TASK) for f, terms in seen.items()}


def term_counts(df: DataFrame, fields: dict[str, tuple[str, ...]] = FIELDS, burst: int = BURST, flush: int = FLUSH) -> DataFrame:
    """(field, term, occurrences, records) of every distinct normal form in the columns of each field.

    A record that holds a term in several columns of a field counts once in `records`. Each worker counts in burst
    tries, one for each route, and hands them on when they hold `flush` terms, so its memory is bounded; subtrees of
    a route are merged in one task. A worker's subtree holds a term once, however often it stands there, so routes are as
    heavy as their distinct terms. Absent labels are no terms. An empty table gives no rows; other columns are not read.
    """
    columns = list(dict.fromkeys(c for cs in fields.values() for c in cs))
    labels = spread(only(df, *columns)).select(*[normal_form(F.col(c)).alias(c) for c in columns])
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = _routes(labels, fields, tasks)
    subtrees = labels.mapInArrow(_counter(fields, shared, burst, flush), SUBTREE)
    met = subtrees.repartition(tasks, "field", "route").sortWithinPartitions("field", "route")
    return met.mapInArrow(_merger(burst), COUNTED)


def marked(counts: DataFrame, n_rows: int, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """Append mark: rare in fewer than `rare` records, common in more than the share `common` of n_rows, else null."""
    return counts.withColumn("mark", F.when(F.col("records") < rare, "rare").when(F.col("records") > F.lit(common) * F.lit(n_rows), "common"))

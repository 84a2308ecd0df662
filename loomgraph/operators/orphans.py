"""References to records that do not exist: keyed state over parent arrivals, removals and references, batch by batch.

The state holds what is known of each parent key and the references that wait. New references probe the parent index;
those that no parent holds wait by id. Parents that arrive, and removals, change the index; where they come late, with a
time before one that was judged already, the references of their keys are judged again, so arrivals resolve and removals
reopen. Counts are reported as each period ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.labels import normal_form
from loomgraph.operators.skew import heavy_labels
from loomgraph.session import only, sent_if_small, spread, written

#: sub-keys for references of heavy keys that no parent holds; batches that a table is divided into at most
SALTS, MOST_BATCHES = 256, 12
#: column of the edge list, and the parent table it refers to
FIELDS = (("src_column", "node_mapping"), ("edge_type_column", "relation_mapping"), ("dst_column", "node_mapping"))


def references(edges: DataFrame, fields: tuple[tuple[str, str], ...] = FIELDS, key: str = "edge_id", at: str = "loaded_at") -> DataFrame:
    """(parent, field, label, ref_id, at) of every label that is not absent."""
    norm = spread(only(edges, key, at, *dict.fromkeys(c for c, _ in fields))).select(F.col(key).alias("ref_id"), F.col(at).alias("at"), *[normal_form(F.col(c)).alias(f"l{i}") for i, (c, _) in enumerate(fields)])
    each = [F.struct(F.lit(p).alias("parent"), F.lit(c).alias("field"), F.col(f"l{i}").alias("label")) for i, (c, p) in enumerate(fields)]
    return norm.select("ref_id", "at", F.explode(F.array(*each)).alias("x")).select("x.parent", "x.field", "x.label", "ref_id", "at").filter(F.col("label").isNotNull())


def parent_events(mapping: DataFrame, parent: str, label: str) -> DataFrame:
    """(parent, label, at, delta): +1 when a row becomes valid, -1 when it is removed, summed per instant.

    Rows without a start, and rows removed no later than they start, are never valid and give no event.
    """
    rows = only(mapping, label, "mapped_at", "removed_at").select(normal_form(F.col(label)).alias("label"), F.col("mapped_at").alias("a"), F.col("removed_at").alias("z"))
    valid = rows.filter(F.col("label").isNotNull() & F.col("a").isNotNull() & (F.col("z").isNull() | (F.col("z") > F.col("a"))))
    steps = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("z").alias("at"), F.lit(-1).alias("delta")))
    return (
        valid.select("label", F.explode(steps).alias("e"))
        .filter(F.col("e.at").isNotNull())
        .groupBy("label", F.col("e.at").alias("at"))
        .agg(F.sum("e.delta").alias("delta"))
        .filter(F.col("delta") != 0)
        .select(F.lit(parent).alias("parent"), "label", "at", "delta")
    )


def live_spans(events: DataFrame) -> DataFrame:
    """(parent, label, since, until): when a key had a parent; until is null for one that it still has. Parents change at an instant before references look."""
    by_key = W.partitionBy("parent", "label").orderBy("at")
    steps = events.groupBy("parent", "label", "at").agg(F.sum("delta").alias("delta"))
    swept = steps.select("parent", "label", F.col("at").alias("since"), F.lead("at").over(by_key).alias("until"), F.sum("delta").over(by_key.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("live"))
    return swept.filter("live > 0").drop("live")


def probe(refs: DataFrame, spans: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """References that no span covers: mapped_at <= at counts as held and removed_at <= at as gone; a reference without a time is held by nothing.

    `heavy` (parent, label; bounded, see skew.heavy_labels) names keys that hold most references: their spans go to all
    workers, so what they hold is settled without a shuffle; what they don't is spread over sub-keys that no span has.
    """
    covers = lambda key, r, s: (key == s["label"]) & (r["parent"] == s["parent"]) & (s["since"] <= r["at"]) & (s["until"].isNull() | (s["until"] > r["at"]))
    if heavy is None:
        return refs.join(spans, covers(refs["label"], refs, spans), "left_anti")
    hot = heavy.select("parent", "label").distinct()
    of_heavy = sent_if_small(spans.join(F.broadcast(hot), ["parent", "label"], "left_semi"), 64)
    left = refs.join(of_heavy, covers(refs["label"], refs, of_heavy), "left_anti").join(F.broadcast(hot.withColumn("_hot", F.lit(True))), ["parent", "label"], "left")
    key = F.when(left["_hot"], F.concat(F.lit("\0"), F.pmod(F.xxhash64("ref_id", "at"), F.lit(SALTS)).cast("string"))).otherwise(left["label"])
    keyed = left.withColumn("_key", key)
    return keyed.join(spans, covers(keyed["_key"], keyed, spans), "left_anti").select("parent", "field", "label", "ref_id", "at")


def orphans_at_load(refs: DataFrame, events: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """References whose label no parent row holds at the moment they arrive, all at once: (parent, field, label, ref_id, at)."""
    return probe(refs, live_spans(events), heavy)


@dataclass(frozen=True)
class State:
    """What is known after some batches, which end before `until`.

    events: of parents, in pieces that are written once each; waiting: references that no parent held when they came;
    judged: the references of all batches, as they were handed in, read again only for keys whose parents come late.
    """

    events: tuple[DataFrame, ...]
    waiting: DataFrame
    judged: tuple[DataFrame, ...]
    until: str


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def step(state: State | None, refs: DataFrame, events: DataFrame, until: str, heavy: DataFrame | None = None) -> State:
    """The state after a batch of references and parent events, all before `until`; any of them may be earlier than the batches before, whatever their order."""
    new = written(events.select("parent", "label", "at", "delta"), "parents")
    if state is None:
        return State((new,), probe(refs, live_spans(new), heavy), (refs,), until)
    known = (*state.events, new)
    spans = live_spans(_all(known))
    late = new.filter(F.col("at") < F.lit(state.until).cast(dict(new.dtypes)["at"])).select("parent", "label").distinct()
    waiting, asked = state.waiting, refs
    if not late.isEmpty():
        late = sent_if_small(late, 64)
        asked = refs.unionByName(_all(state.judged).join(late, ["parent", "label"], "left_semi").select(*refs.columns))
        waiting = waiting.join(late, ["parent", "label"], "left_anti")
    return State(known, waiting.unionByName(probe(asked, spans, heavy)), (*state.judged, refs), max(until, state.until))


def periods(moments: DataFrame, at: str = "at") -> list[tuple[str | None, str | None]]:
    """(from, to) of years in which something happens, open at the start and the end; at most MOST_BATCHES."""
    years = sorted(r.year for r in moments.select(F.year(at).alias("year")).distinct().collect() if r.year is not None)
    starts = [f"{y:04d}-01-01 00:00:00" for y in years[:: max(1, -(-len(years) // MOST_BATCHES))]] or ["0001-01-01 00:00:00"]
    return list(zip([None, *starts[1:]], [*starts[1:], None]))


def batches(refs: DataFrame, events: DataFrame, spans: Sequence[tuple[str | None, str | None]]) -> Iterator[tuple[DataFrame, DataFrame, str]]:
    """References and events of each period, and its end; references without a time come first."""

    def within(df: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
        moment = lambda x: F.lit(x).cast(dict(df.dtypes)["at"])
        known = df if lo is None else df.filter(F.col("at") >= moment(lo))
        return known if hi is None else known.filter((F.col("at") < moment(hi)) | F.col("at").isNull()) if lo is None else known.filter(F.col("at") < moment(hi))

    for lo, hi in spans:
        yield within(refs, lo, hi), within(events, lo, hi), hi or "9999-12-31 23:59:59"


def advance(state: DataFrame | None, refs: DataFrame, events: DataFrame) -> DataFrame:
    """The keyed state after a batch: (parent, label, live, n_refs).

    `live` is the number of parent rows valid at the end of the batch, `n_refs` the number of references seen so far.
    Keys with live = 0 are pending: an arriving parent resolves all their references at once, a removal of the last
    parent reopens them. Only sums are kept, so a batch costs one aggregation of the batch and a merge with the state.
    """
    new = events.groupBy("parent", "label").agg(F.sum("delta").alias("live"), F.lit(0).cast("bigint").alias("n_refs")).unionByName(
        refs.groupBy("parent", "label").agg(F.lit(0).cast("bigint").alias("live"), F.count(F.lit(1)).alias("n_refs"))
    )
    both = new if state is None else new.unionByName(state)
    return both.groupBy("parent", "label").agg(F.sum("live").alias("live"), F.sum("n_refs").alias("n_refs"))


def pending(state: DataFrame) -> DataFrame:
    """(parent, n_labels, n_refs) that wait for a parent in this state."""
    return state.filter((F.col("live") <= 0) & (F.col("n_refs") > 0)).groupBy("parent").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n_refs").alias("n_refs"))


def snapshots(state: DataFrame | None, refs: DataFrame, events: DataFrame) -> DataFrame:
    """(parent, month, n_pending) at the end of each month of a batch in which something happened, after the batches that `state` (see advance) sums up.

    Events and references are summed per key and month before any shuffle of them; a key then has one row a month, and
    one for the state it comes with. References without a time are not counted.
    """
    month = F.date_format(F.date_trunc("month", "at"), "yyyy-MM")
    none = F.lit(0).cast("bigint")
    steps = (
        events.withColumn("month", month).groupBy("parent", "label", "month").agg(F.sum("delta").alias("delta"), none.alias("n"))
        .unionByName(refs.filter(F.col("at").isNotNull()).withColumn("month", month).groupBy("parent", "label", "month").agg(none.alias("delta"), F.count(F.lit(1)).alias("n")))
    )
    if state is not None:
        steps = steps.unionByName(state.select("parent", "label", F.lit("").alias("month"), F.col("live").alias("delta"), F.col("n_refs").alias("n")))
    steps = steps.groupBy("parent", "label", "month").agg(F.sum("delta").alias("delta"), F.sum("n").alias("n"))
    by_key = W.partitionBy("parent", "label").orderBy("month")
    running = by_key.rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = steps.select("parent", "label", "month", F.sum("delta").over(running).alias("live"), F.sum("n").over(running).alias("seen"))
    open_ = swept.withColumn("open", F.when(F.col("live") <= 0, F.col("seen")).otherwise(F.lit(0)))
    change = open_.withColumn("change", F.col("open") - F.coalesce(F.lag("open").over(by_key), F.lit(0)))
    per_month = change.groupBy("parent", "month").agg(F.sum("change").alias("change"))
    total = W.partitionBy("parent").orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row for each month
    return per_month.select("parent", "month", F.sum("change").over(total).alias("n_pending")).filter("month <> ''")


def pending_snapshots(refs: DataFrame, events: DataFrame, spans: Sequence[tuple[str | None, str | None]] = ((None, None),)) -> DataFrame:
    """snapshots() batch by batch, each from the keyed state that the one before left."""
    state, out = None, []
    for i, (r, e, _) in enumerate(batches(refs, events, spans)):
        out.append(snapshots(state, r, e))
        if i + 1 < len(spans):
            state = written(advance(state, r.filter(F.col("at").isNotNull()), e), "pending")
    return _all(out)


def all_parent_events(node_mapping: DataFrame, relation_mapping: DataFrame) -> DataFrame:
    return parent_events(node_mapping, "node_mapping", "node_label").unionByName(parent_events(relation_mapping, "relation_mapping", "relation_label"))


def edge_list_orphans(edges: DataFrame, node_mapping: DataFrame, relation_mapping: DataFrame) -> DataFrame:
    """What waits, by id, after step() has taken an edge list and its two mapping tables year by year: the references that no parent held at load.

    Absent labels refer to nothing. Repeated rows refer each. Empty tables give no rows; without mappings all wait.
    """
    parent_of = F.create_map(*[F.lit(x) for pair in FIELDS for x in pair])
    heavy = written(heavy_labels(edges, tuple(c for c, _ in FIELDS)).select(parent_of[F.col("field")].alias("parent"), F.col("term").alias("label")), "heavy")
    state = None
    for refs, events, until in batches(references(edges), all_parent_events(node_mapping, relation_mapping), periods(only(edges, "loaded_at"), "loaded_at")):
        state = step(state, refs, events, until, heavy)
    return state.waiting

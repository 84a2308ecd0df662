"""Node partitions, edge buckets, and the order in which a bounded buffer visits them."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.hashing import digest, draw
from loomgraph.operators.order import exclusive_sums


def partition_size(n_nodes: int, n_parts: int) -> int:
    return -(-n_nodes // n_parts)


def with_parts(edges: DataFrame, n_nodes: int, n_parts: int) -> DataFrame:
    """Append src_part and dst_part: contiguous id ranges of equal size, the last one may be smaller."""
    size = F.lit(partition_size(n_nodes, n_parts))
    return edges.withColumn("src_part", F.floor(F.col("src") / size).cast("int")).withColumn("dst_part", F.floor(F.col("dst") / size).cast("int"))


def bucket_counts(parted: DataFrame) -> DataFrame:
    """(src_part, dst_part, n_edges) of buckets that have edges."""
    return parted.groupBy("src_part", "dst_part").agg(F.count(F.lit(1)).alias("n_edges"))


def bucket_grid(spark: SparkSession, parted: DataFrame, n_parts: int) -> DataFrame:
    """(src_part, dst_part, n_edges, offset_before) of all n_parts ** 2 buckets in row-major order."""
    grid = spark.range(n_parts * n_parts).select(F.floor(F.col("id") / n_parts).cast("int").alias("src_part"), (F.col("id") % n_parts).cast("int").alias("dst_part"))
    counted = grid.join(bucket_counts(parted), ["src_part", "dst_part"], "left").fillna(0, ["n_edges"])
    return exclusive_sums(counted, ["src_part", "dst_part"], "n_edges")


def sorted_buckets(parted: DataFrame, n_files: int) -> DataFrame:
    """Edges laid out by bucket, and by src within a bucket, ready to be written; no global sort takes place."""
    return parted.repartitionByRange(n_files, "src_part", "dst_part", "src").sortWithinPartitions("src_part", "dst_part", "src", "dst")


def induced_subgraph(parted: DataFrame, resident: Iterable[int]) -> DataFrame:
    """Edges with both ends in resident partitions; on a table written with these columns it prunes files."""
    parts = list(resident)
    return parted.filter(F.col("src_part").isin(parts) & F.col("dst_part").isin(parts))


def beta_states(n_parts: int, capacity: int, seed: int = 0) -> list[tuple[int, ...]]:
    """Buffer states that bring every pair of partitions together, each one swap away from the one before.

    The last slot takes in every partition that isn't resident, one after another; then the other slots, which have met
    all of them by now, give way one by one to partitions still to be met.
    """
    if not 2 <= capacity:
        raise ValueError("a buffer needs two slots to hold a pair")
    order = list(range(n_parts))
    random.Random(seed).shuffle(order)
    held, away = order[:capacity], order[capacity:]
    states = [tuple(held)]
    while away:
        for k in range(len(away)):
            held[-1], away[k] = away[k], held[-1]
            states.append(tuple(held))
        for slot in range(capacity - 1):
            if not away:
                break
            held[slot] = away.pop(0)
            states.append(tuple(held))
    return states


def two_level_states(n_parts: int, capacity: int, ratio: int, n_cached: int = 0, seed: int = 0) -> list[tuple[int, ...]]:
    """States over groups of `ratio` partitions, drawn at random, with n_cached groups resident all along."""
    if n_parts % ratio or capacity % ratio:
        raise ValueError("ratio must divide the partitions and the capacity")
    members = list(range(n_parts))
    random.Random(seed).shuffle(members)
    groups = [members[k : k + ratio] for k in range(0, n_parts, ratio)]
    coarse, slots = len(groups) - n_cached, capacity // ratio - n_cached
    visits = [tuple(range(coarse))] if slots >= coarse else beta_states(coarse, slots, seed + 1)
    cached = [p for g in groups[coarse:] for p in g]
    return [tuple([p for g in state for p in groups[g]] + cached) for state in visits]


def dispersed_states(n_parts: int, capacity: int, seed: int = 0) -> list[tuple[int, ...]]:
    """For nodes: one random partition is swapped in at a time until each has been resident."""
    rng = random.Random(seed)
    order = list(range(n_parts))
    rng.shuffle(order)
    held = order[:capacity]
    states = [tuple(held)]
    for p in order[capacity:]:
        held[rng.randrange(capacity)] = p
        states.append(tuple(held))
    return states


def sequential_state(n_parts: int, capacity: int, train_parts: Sequence[int], seed: int = 0) -> list[tuple[int, ...]]:
    """For nodes: one state of all partitions with train nodes, filled up at random."""
    if len(train_parts) > capacity:
        raise ValueError("the train partitions don't fit into the buffer")
    rest = [p for p in range(n_parts) if p not in set(train_parts)]
    return [tuple([*train_parts, *random.Random(seed).sample(rest, min(len(rest), capacity - len(train_parts)))])]


def buffer_states(kind: str, n_parts: int, capacity: int, ratio: int = 1, n_cached: int = 0, seed: int = 0) -> list[tuple[int, ...]]:
    """By name: beta, two_level, dispersed."""
    if kind == "beta":
        return beta_states(n_parts, capacity, seed)
    if kind == "two_level":
        return two_level_states(n_parts, capacity, ratio, n_cached, seed)
    if kind == "dispersed":
        return dispersed_states(n_parts, capacity, seed)
    raise ValueError(f"no such order: {kind}")


def states_table(spark: SparkSession, states: Sequence[Sequence[int]]) -> DataFrame:
    """(state_id, slot, part)."""
    return spark.createDataFrame([(s, k, p) for s, state in enumerate(states) for k, p in enumerate(state)], "state_id int, slot int, part int")


def _pairs(states: DataFrame) -> DataFrame:
    a = states.select("state_id", F.col("part").alias("src_part"))
    return a.join(states.select("state_id", F.col("part").alias("dst_part")), "state_id")


def greedy_assignment(states: DataFrame) -> DataFrame:
    """(src_part, dst_part, state_id): each bucket goes to the first state that holds both of its partitions."""
    return _pairs(states).groupBy("src_part", "dst_part").agg(F.min("state_id").alias("state_id"))


def random_assignment(states: DataFrame, seed: int = 0) -> DataFrame:
    """Each bucket goes to one of the states that hold both of its partitions, drawn evenly."""
    w = W.partitionBy("src_part", "dst_part").orderBy(digest(seed, "src_part", "dst_part", "state_id"), "state_id")
    return _pairs(states).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def swaps(states: DataFrame) -> DataFrame:
    """(state_id, part, change): partitions admitted and evicted on the way to state_id from the one before."""
    now = states.select("state_id", "part")
    last = states.select((F.col("state_id") + 1).alias("state_id"), "part")
    has_last = F.col("state_id") > 0
    n = states.agg(F.max("state_id").alias("top"))
    admitted = now.filter(has_last).join(last, ["state_id", "part"], "left_anti").withColumn("change", F.lit("admit"))
    evicted = last.join(now, ["state_id", "part"], "left_anti").join(F.broadcast(n)).filter(F.col("state_id") <= F.col("top")).drop("top").withColumn("change", F.lit("evict"))  # n: one row
    return admitted.unionByName(evicted)


def buffer_map(nodes: DataFrame, states: DataFrame, n_nodes: int, n_parts: int) -> DataFrame:
    """(state_id, id, slot_id): the place of each node in the buffer of each state, -1 where it isn't resident."""
    size = partition_size(n_nodes, n_parts)
    parted = nodes.select("id", F.floor(F.col("id") / size).cast("int").alias("part"))
    where = states.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state_id", "slot"))).alias("slots"))  # one row a partition
    ids = states.agg(F.sort_array(F.collect_set("state_id")).alias("ids"))
    placed = parted.join(where, "part", "left").join(F.broadcast(ids)).select("id", "part", "slots", F.explode("ids").alias("state_id"))  # ids: one row
    slot = F.col("slots")[F.col("state_id")]
    return placed.select("state_id", "id", F.coalesce(slot * size + F.col("id") - F.col("part") * size, F.lit(-1)).cast("bigint").alias("slot_id"))


def away(states: DataFrame, n_parts: int) -> DataFrame:
    """(state_id, part): partitions that aren't resident in each state."""
    every = states.sparkSession.range(n_parts).select(F.col("id").cast("int").alias("part"))
    ids = states.agg(F.collect_set("state_id").alias("ids"))  # one row
    pairs = every.join(F.broadcast(ids)).select(F.explode("ids").alias("state_id"), "part")
    return pairs.join(states.select("state_id", "part"), ["state_id", "part"], "left_anti")


def nodes_of_states(nodes: DataFrame, states: DataFrame, n_nodes: int, n_parts: int, seed: int = 0) -> DataFrame:
    """(id, state_id): each node goes to one of the states that hold its partition, drawn evenly."""
    parted = nodes.select("id", F.floor(F.col("id") / partition_size(n_nodes, n_parts)).cast("int").alias("part"))
    where = states.groupBy("part").agg(F.array_sort(F.collect_list("state_id")).alias("states"))  # one row a partition
    drawn = draw(seed, "id") % F.size("states")
    return parted.join(where, "part").select("id", F.col("states")[drawn.cast("int")].alias("state_id"))

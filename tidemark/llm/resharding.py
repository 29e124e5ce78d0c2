"""Resharding by minimum-cost flow: the transfers that move the fewest bytes.

Old shards supply their bytes, new shards take equal shares; a byte that stays costs nothing and a
byte that moves costs one. Only the shards' sums reach the driver, where the flow is solved. Each old
shard's rows, in a fixed order, are then cut at the flow's amounts by running sums over blocks, and
rows across a cut go, largest first, where most is missing. Files of shards that nothing enters or
leaves need no rewriting.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

from .common import col, groups_for, plain


def min_cost_flow(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a maximum flow of least cost, by shortest augmenting paths."""
    to, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, capacity, price in edges:
        for u, v, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            out[u].append(len(to))
            to.append(v)
            room.append(c)
            cost.append(w)
    while True:
        far, via, waiting = [float("inf")] * nodes, [-1] * nodes, deque([source])
        far[source] = 0
        while waiting:
            u = waiting.popleft()
            for e in out[u]:
                if room[e] and far[u] + cost[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[u] + cost[e], e
                    waiting.append(to[e])
        if via[sink] < 0:
            return [room[2 * i + 1] for i in range(len(edges))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def transfers(supply: dict[int, int], shards: int) -> dict[int, list[tuple[int, int]]]:
    """For each old shard, (new shard, bytes): what stays first, then what moves. New shares are equal to a byte."""
    old, total = sorted(supply), sum(supply.values())
    share = [total // shards + (j < total % shards) for j in range(shards)]
    source, sink = 0, len(old) + shards + 1
    edges = [(source, 1 + i, supply[o], 0) for i, o in enumerate(old)]
    between = [(i, j) for i in range(len(old)) for j in range(shards)]
    edges += [(1 + i, 1 + len(old) + j, supply[old[i]], int(old[i] != j)) for i, j in between]
    edges += [(1 + len(old) + j, sink, share[j], 0) for j in range(shards)]
    flow = min_cost_flow(sink + 1, edges, source, sink)
    plan: dict[int, list[tuple[int, int]]] = {o: [] for o in old}
    for (i, j), amount in zip(between, flow[len(old) :], strict=False):
        if amount:
            plan[old[i]].append((j, amount))
    return {o: sorted(x, key=lambda y: (y[0] != o, y[0])) for o, x in plan.items()}


@dataclass(frozen=True)
class Placed:
    rows: DataFrame  # the documents with size, text_crc32, old_shard, shard and slot
    plan: dict[int, list[tuple[int, int]]]

    @property
    def affected(self) -> list[int]:
        """Shards, old ones too, that anything enters or leaves; the others' files stay as they are."""
        into = {j for o, x in self.plan.items() for j, _ in x if j != o}
        left = {o for o, x in self.plan.items() if any(j != o for j, _ in x)}
        return sorted(into | left)


def _choose(cases: list[tuple[Column, int]], otherwise: Column) -> Column:
    return reduce(lambda rest, c: F.when(c[0], F.lit(c[1])).otherwise(rest), reversed(cases), otherwise)


def reshard(docs: DataFrame, old_shard: Column, shards: int = 16, block_rows: int = 100_000, block_bytes: int = 64 << 20, id: str = "doc_id", text: str = "text") -> Placed:
    """Places every row in a shard of nearly equal bytes, moving as few as it can.

    Size: UTF-8 bytes of the text (null: none) plus 1. `old_shard` says where a row is now (null: in
    shard 0). Rows are ordered by number (null first) and text hash; equal rows may stand in either
    order. They are sorted in blocks of about `block_rows` rows and `block_bytes` bytes, dealt by a
    hash. Input columns named like an output are replaced, all others are passed on. An empty table
    gives an empty result and an empty plan.
    """
    outputs = ["size", "text_crc32", "old_shard", "shard", "slot"]
    old = F.coalesce(old_shard.cast("int"), F.lit(0))
    marker = "_old_"
    while marker in {c.lower() for c in docs.columns}:
        marker += "_"
    docs = docs.withColumn(marker, old)
    docs, names, (id, text, where) = plain(docs, outputs, id, text, marker)
    names.remove(marker)
    body = F.coalesce(col(text), F.lit(""))
    rows = docs.withColumns({"_size": (F.octet_length(body) + 1).cast("long"), "_crc": F.crc32(F.encode(body, "UTF-8")), "_tie": F.xxhash64(body)})
    rows = rows.withColumn("_old", col(where)).drop(where)
    sums = {r[0]: (r[1], r[2]) for r in rows.groupBy("_old").agg(F.sum("_size"), F.count(F.lit(1))).collect()}
    plan = transfers({o: s for o, (s, _) in sums.items()}, shards)
    blocks = max(groups_for(sum(n for _, n in sums.values()), block_rows), groups_for(sum(s for s, _ in sums.values()), block_bytes))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(id, "_tie"), F.lit(blocks)).cast("int"))

    bytes_before = Window.partitionBy("_old").orderBy("_block")
    totals = rows.groupBy("_old", "_block").agg(F.sum("_size").alias("_sum"))
    totals = totals.select("_old", "_block", (F.sum("_sum").over(bytes_before) - F.col("_sum")).alias("_before"))
    order = Window.partitionBy("_old", "_block").orderBy(id, "_tie")
    running = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    at = rows.withColumn("_within", running).join(totals, ["_old", "_block"]).withColumn("_at", F.col("_before") + F.col("_within"))
    cuts = [(o, sum(n for _, n in x[: i + 1])) for o, x in plan.items() for i in range(len(x) - 1)]
    across = reduce(lambda a, b: a | b, [(F.col("_old") == o) & (F.col("_at") < c) & (F.col("_at") + F.col("_size") > c) for o, c in cuts], F.lit(False))
    kept = staged(at.withColumn("_across", across), "offsets")

    whole = [((F.col("_old") == o) & (F.col("_at") < sum(n for _, n in x[: i + 1])), j) for o, x in plan.items() for i, (j, _) in enumerate(x)]
    first = _choose(whole, F.lit(0))
    have = {r[0]: r[1] for r in kept.where("NOT _across").groupBy(first.alias("s")).agg(F.sum("_size")).collect()}
    missing = [sum(sums[o][0] for o in sums) / shards - have.get(j, 0) for j in range(shards)]
    own: list[tuple[Column, int]] = []
    for old_number, place, size in sorted((tuple(r) for r in kept.where("_across").select("_old", "_at", "_size").collect()), key=lambda r: (-r[2], r[0], r[1])):  # one for each cut at most
        shard = max(range(shards), key=lambda j: (missing[j], -j))
        missing[shard] -= size
        own.append(((F.col("_old") == old_number) & (F.col("_at") == place), shard))
    put = kept.withColumn("_shard", F.when(F.col("_across"), _choose(own, F.lit(0))).otherwise(first).cast("int"))

    counts = put.groupBy("_shard", "_old", "_block").agg(F.count(F.lit(1)).alias("_n"))
    slots_before = Window.partitionBy("_shard").orderBy("_old", "_block")
    counts = counts.select("_shard", "_old", "_block", (F.sum("_n").over(slots_before) - F.col("_n")).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_shard", "_old", "_block").orderBy(id, "_tie", "_at")) - 1
    done = put.withColumn("_row", within).join(counts, ["_shard", "_old", "_block"])
    kept_names = [c for c in docs.columns if c != where]
    result = done.select(*kept_names, "_size", "_crc", "_old", "_shard", (F.col("_first") + F.col("_row")).cast("long"))
    return Placed(result.toDF(*names, *outputs), plan)


def rewrite(placed: Placed, folder: str) -> None:
    """Writes the affected shards under `folder`, each its own directory; the other directories stay.

    Affected shards that hold no row any more lose their directory, after the others are written: a
    run that stops in between is repeated whole. `placed` reads its own staged copy, not `folder`.
    """
    rows = placed.rows.where(F.col("shard").isin(placed.affected or [-1])).repartition("shard").sortWithinPartitions("shard", "slot")
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("shard").mode("overwrite").parquet(folder)
    filled = {r[0] for r in placed.rows.groupBy("shard").count().select("shard").collect()}  # one for each shard at most
    spark = placed.rows.sparkSession
    for shard in sorted(set(placed.affected) - filled):
        old = spark._jvm.org.apache.hadoop.fs.Path(folder, f"shard={shard}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

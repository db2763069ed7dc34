"""K-d tree sharding: leaves of near-equal bytes over several metadata dimensions.

Every node is split at the weighted median (weight: bytes) along the dimension in which its rows spread widest,
until leaves reach the target bytes. The median is found for all nodes of a level at once: rounds of weighted
histograms over 64-bit keys, each round a partial aggregation of (node, bin) sums, narrow the interval that holds
the median until it is one key. A key is the row's coordinate in the node's dimension with a hash of doc_id below
it, so a value that a third of the rows share is split as well, and sibling nodes differ by a document's size
or so. Nothing but histograms of at most MAX_CELLS rows reaches the driver.

Coordinates are 31-bit ranks, approximate and in order of the values, so that widths of different dimensions compare:
RANKS quantiles, and the place between two of them. Strings count as the number that their first STRING_BYTES bytes
after the prefix that all have make. Null coordinates are 0. Each level is a stored table; a row finds its node's
axis and cut in a broadcast table of the level's nodes, of which there are fewer than leaves. An empty table gives an
empty result. Rows with equal doc_id and text share a key and fall into the same leaf. A very long text is one row
of its size. Columns beside the stated ones are ignored.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import discard, numbered_within, stored

#: In a tie of widths the first is split.
DIMENSIONS = ("doc_id", "source", "lang", "n_chars")
COORDINATE_BITS = 31
TIE_BITS = 31
BIN_BITS = 12
MAX_CELLS = 1 << 18
RANKS = 32
STRING_BYTES = 6


def _numbers(rows: DataFrame, dimensions: list[str]) -> list[Column]:
    """The dimensions as numbers in the order of their values."""
    strings = [d for d in dimensions if dict(rows.dtypes)[d] == "string"]
    ends = rows.agg(*[f(F.col(d)).alias(f"{n}_{d}") for d in strings for n, f in (("lo", F.min), ("hi", F.max))]).first() if strings else None
    out = []
    for d in dimensions:
        if d in strings:
            same = len(os.path.commonprefix([(ends[f"{n}_{d}"] or "").encode() for n in ("lo", "hi")]))
            shown = F.rpad(F.hex(F.substring(F.encode(F.col(d), "UTF-8"), same + 1, STRING_BYTES)), 2 * STRING_BYTES, "0")
            out.append(F.conv(shown, 16, 10).cast("double"))
        else:
            out.append(F.col(d).cast("double"))
    return out


def _coordinates(rows: DataFrame, dimensions: list[str]) -> list[Column]:
    numbers = _numbers(rows, dimensions)
    shares = [i / RANKS for i in range(RANKS + 1)]
    found = rows.agg(*[F.percentile_approx(x, shares, 1000).alias(f"c{i}") for i, x in enumerate(numbers)]).first()
    out = []
    for i, x in enumerate(numbers):
        cuts = sorted({float(c) for c in found[f"c{i}"] or []})
        if len(cuts) < 2:
            out.append(F.lit(0).cast("long"))
            continue
        # the place among the quantiles, of which equal ones are one, and between two of them
        below = reduce(lambda a, b: a + b, [(x >= c).cast("int") for c in cuts[1:-1]], F.lit(0))
        held = F.array(*[F.lit(c) for c in cuts])
        low, high = F.get(held, below), F.get(held, below + 1)
        place = below + F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        scaled = F.floor(place / (len(cuts) - 1) * float((1 << COORDINATE_BITS) - 1)).cast("long")
        out.append(F.coalesce(scaled, F.lit(0).cast("long")))
    return out


def _of_nodes(rows: DataFrame, values: dict[int, tuple[int, ...]], names: str) -> DataFrame:
    """Rows with their node's values; rows of other nodes have nulls."""
    columns = [f"{n} long" for n in names.split()]
    table = rows.sparkSession.createDataFrame([(n, *v) for n, v in values.items()], ", ".join(["__node int", *columns]))
    return rows.join(F.broadcast(table), F.col("node") == F.col("__node"), "left").drop("__node")


def _split_keys(rows: DataFrame, nodes: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node (its rows' dimension is in column key): the largest key that goes left.

    nodes: node -> (total bytes, share of the bytes that go left).
    """
    width = COORDINATE_BITS + TIE_BITS
    bin_bits = BIN_BITS
    while len(nodes) << bin_bits > MAX_CELLS and bin_bits > 1:
        bin_bits -= 1
    low = {n: 0 for n in nodes}  # the median's prefix so far
    before = {n: 0 for n in nodes}  # bytes of keys below the prefix
    while width > 0:
        take = min(bin_bits, width)
        inside = _of_nodes(rows, {n: (x,) for n, x in low.items()}, "prefix").where(F.shiftright("key", width) == F.col("prefix"))
        cells = inside.groupBy("node", F.shiftright("key", width - take).alias("cell")).agg(F.sum("size").alias("b")).collect()
        width -= take
        by_node: dict[int, list[tuple[int, int]]] = {n: [] for n in nodes}
        for r in cells:
            by_node[r.node].append((r.cell, r.b))
        for n, found in by_node.items():
            goal = nodes[n][0] * nodes[n][1]
            found.sort()
            for k, (cell, b) in enumerate(found):
                if before[n] + b >= goal or k == len(found) - 1:
                    low[n] = cell
                    break
                before[n] += b
    # the last key goes to the side that it leaves nearer to the goal
    last = _of_nodes(rows, {n: (x,) for n, x in low.items()}, "cut").where(F.col("key") == F.col("cut"))
    sizes = {r.node: r.b for r in last.groupBy("node").agg(F.sum("size").alias("b")).collect()}
    return {n: low[n] if nodes[n][0] * nodes[n][1] - before[n] >= sizes.get(n, 0) / 2 else low[n] - 1 for n in nodes}


def kd_shards(rows: DataFrame, dimensions: list[str], leaves: int) -> DataFrame:
    """Add shard (0 to leaves - 1) to rows, a stored table with doc_id, size and the dimensions.

    A node of k leaves is split into ceil(k/2) and floor(k/2) leaves at that share of its bytes, so any number
    of leaves works.
    """
    size = len(dimensions)
    tree = rows.select(
        "*",
        *[c.alias(f"__c{i}") for i, c in enumerate(_coordinates(rows, dimensions))],
        F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col("doc_id")), 64 - TIE_BITS).alias("__tie"),
        F.lit(0).alias("node"),
    )
    tree = stored(tree, "root")
    plan = {0: (0, leaves)}  # node -> first leaf, leaves
    while any(k > 1 for _, k in plan.values()):
        wide = {n: v for n, v in plan.items() if v[1] > 1}
        spread = _of_nodes(tree, {n: (1,) for n in wide}, "wide").where("wide = 1").groupBy("node").agg(F.sum("size").alias("b"), *[(F.max(f"__c{i}") - F.min(f"__c{i}")).alias(f"s{i}") for i in range(size)]).collect()
        widest = {r.node: max(range(size), key=lambda i, r=r: (r[f"s{i}"] >> (COORDINATE_BITS - 5), -i)) for r in spread}  # widths within a thirtieth tie
        totals = {r.node: (r.b, -(-wide[r.node][1] // 2) / wide[r.node][1]) for r in spread}
        plan = {n: v if n not in wide else (v[0], 1) for n, v in plan.items()}  # a node without rows stays a leaf
        if not totals:
            break
        chosen = F.coalesce(*[F.when(F.col("axis") == i, F.col(f"__c{i}")) for i in range(size)])
        keyed = _of_nodes(tree, {n: (i,) for n, i in widest.items()}, "axis").withColumn("key", F.shiftleft(chosen, TIE_BITS).bitwiseOR(F.col("__tie"))).drop("axis")
        cuts = _split_keys(keyed.where(F.col("key").isNotNull()).select("node", "key", "size"), totals)
        last, right = max(plan) + 1, {}
        for k, n in enumerate(sorted(totals)):
            left_leaves = -(-wide[n][1] // 2)
            right[n] = last + k
            plan[n] = (wide[n][0], left_leaves)
            plan[last + k] = (wide[n][0] + left_leaves, wide[n][1] - left_leaves)
        placed = _of_nodes(keyed, {n: (c, right[n]) for n, c in cuts.items()}, "cut right")
        below, tree = tree, stored(placed.withColumn("node", F.when(F.col("key") > F.col("cut"), F.col("right")).otherwise(F.col("node")).cast("int")).drop("key", "cut", "right"), "level")
        discard(below)
    out = _of_nodes(tree, {n: (first,) for n, (first, _) in plan.items()}, "shard").withColumn("shard", F.col("shard").cast("int"))
    return out.drop("node", "__tie", *[f"__c{i}" for i in range(size)])


def shard_documents(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Give the number of leaves, or the target bytes of a leaf.
    """
    dimensions = [d for d in DIMENSIONS if d in docs.columns]
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = stored(docs.select(*dimensions, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "sizes")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    leaves = leaves or max(1, -(-(whole.b or 0) // (target_bytes or 1 << 30)))
    if whole.n == 0:
        placed = rows.withColumn("shard", F.lit(0))
    else:
        placed = stored(kd_shards(rows, dimensions, leaves), "shards")
    out = numbered_within(placed.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id"], "slot", whole.n, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, leaves: int | None = None, target_bytes: int | None = None) -> None:
    """Write the documents below path, one folder shard=N for each leaf. Equal rows of one doc_id stay together."""
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    placed = shard_documents(docs, leaves, target_bytes).groupBy(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc")).agg(F.min("shard").alias("shard"))
    docs.join(placed, F.col("doc_id").eqNullSafe(F.col("__id")) & (crc == F.col("__crc"))).drop("__id", "__crc").repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy("shard").parquet(path)

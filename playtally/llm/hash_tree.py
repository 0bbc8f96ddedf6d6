"""Sharding by a hierarchical tree of weighted hash draws: region, rack, shard."""

from __future__ import annotations

import math
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtally.llm.shared import documents, keyed_texts, stored

SHARDS = 24
RACKS_OF_REGION = 4
SHARDS_OF_RACK = 2
#: Bytes a row takes besides its text.
ROW_BYTES = 8
#: Text bytes of a file that ``write_shards`` aims at.
FILE_BYTES = 256 << 20
_LEVELS = 3


@dataclass(frozen=True)
class Leaf:
    """A shard, where it stands, and its share of the rows relative to other shards."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int = SHARDS, base: int = SHARDS) -> tuple[Leaf, ...]:
    """Shards 0 to ``shards`` - 1 of equal weight.

    The first ``base`` fill racks of two and regions of four racks. Each later
    one is a region of its own, so that one shard more changes the weight of no
    node that was there and takes rows only into itself.
    """
    leaves = []
    for shard in range(shards):
        if shard < base:
            rack = shard // SHARDS_OF_RACK
            leaves.append(Leaf(shard, f"g{rack // RACKS_OF_REGION}", f"k{rack}"))
        else:
            leaves.append(Leaf(shard, f"+{shard}", f"+{shard}"))
    return tuple(leaves)


def children(tree: tuple[Leaf, ...]) -> dict[str, list[tuple[str, float]]]:
    """For each inner node, its children and their weights; the root is ''.

    A node's weight is the sum of its shards'. Shards of no weight get no rows
    and are left out. Names are paths, so a node keeps its draws wherever
    shards are added.
    """
    if len({leaf.shard for leaf in tree}) != len(tree):
        raise ValueError("a shard stands twice in the tree")
    sums: dict[str, dict[str, float]] = {}
    for leaf in tree:
        if leaf.weight < 0:
            raise ValueError("weights must not be negative")
        if leaf.weight == 0:
            continue
        path = ["", f"/{leaf.region}", f"/{leaf.region}/{leaf.rack}", f"/{leaf.region}/{leaf.rack}/{leaf.shard}"]
        for parent, child in zip(path, path[1:], strict=False):
            own = sums.setdefault(parent, {})
            own[child] = own.get(child, 0.0) + leaf.weight
    if not sums:
        raise ValueError("a tree needs a shard of positive weight")
    return {parent: sorted(own.items()) for parent, own in sums.items()}


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard (int) that ``key`` falls to: one weighted draw among the children at each level.

    A child draws -ln(u) / weight, u from the XXH64 of its path and the key; the
    least draw wins. A child of more weight draws less for every key, so keys
    only move to or from nodes whose weight changed, and within a subtree
    nothing moves unless a weight in it did. A null key has draws of its own
    (those of the text "null"). Work per row grows with the children along the path,
    not with the number of shards.
    """
    name = F.coalesce(key.cast("string"), F.lit("null"))
    below = children(tree)
    table = F.create_map(
        *[
            x
            for parent, own in sorted(below.items())
            for x in (
                F.lit(parent),
                F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in own]),
            )
        ]
    )

    def draw(child: Column) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(F.concat(child["name"], F.lit(" "), name)), 11)
        u = (h.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    node = F.lit("")
    for _ in range(_LEVELS):
        node = F.array_min(F.transform(F.element_at(table, node), draw))["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def place(
    docs: DataFrame,
    tree: tuple[Leaf, ...],
    grown: tuple[Leaf, ...] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard), one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes and ``ROW_BYTES``; a null text is empty.
    ``shard`` depends on the id and ``tree`` only, ``grown_shard`` on the id and
    ``grown`` (null without one). ``slot`` counts the rows of a shard from 0, by
    id (nulls first), CRC, size; rows equal in these are counted in the order
    they are read. No rows give no rows; other columns of ``docs`` are ignored.

    Slots need no pass of one task over a shard: narrow rows are range-parted by
    shard and sort key, every part numbers its own, and the parts' sizes give
    the offsets. A place in the read order ends each sort key, so that a part
    border can fall anywhere, between repeated rows too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keyed_texts(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Range-parting reads its input twice; so it reads narrow rows, not texts.
    rows = stored(rows, "placed")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", "doc_id", "text_crc32", "size", "at"]
    numbered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "id", F.monotonically_increasing_id()
    )
    numbered = stored(
        numbered.select(
            *[c for c in rows.columns if c != "at"],
            F.shiftrightunsigned("id", 33).cast("int").alias("part"),
            F.col("id").bitwiseAND((1 << 33) - 1).alias("row"),
        ),
        "numbered",
    )
    # At most one row per part and shard that meet: parts + shards rows, whatever the input.
    spans = numbered.groupBy("part", "shard").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    spans = spans.select(F.col("part").alias("p"), F.col("shard").alias("s"), (before - F.col("first")).alias("shift"))
    joined = numbered.join(F.broadcast(spans), (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    return joined.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).alias("slot"), "grown_shard"
    )


def write_shards(
    docs: DataFrame,
    tree: tuple[Leaf, ...],
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> None:
    """``docs`` as Parquet under ``path``, one folder ``shard=N`` per shard that has rows.

    A shard's rows are dealt over as many tasks as its text has ``file_bytes``,
    in the order they are read, so a shard that a repeated id fills is written
    by many tasks too. All columns and repeated rows stay. A column ``shard``
    of ``docs`` would clash with the folders and is refused.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard")
    dealt = docs.withColumn("shard", shard_of(F.col(f"`{id_col}`"), tree))
    # One row a shard.
    sizes = dealt.groupBy("shard").agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))).alias("n")).collect()
    files = F.create_map(*[F.lit(x) for r in sizes for x in (r.shard, 1 + (r.n or 0) // file_bytes)]) if sizes else None
    salt = F.pmod(F.monotonically_increasing_id(), F.element_at(files, F.col("shard"))) if sizes else F.lit(0)
    dealt.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def moved(before: DataFrame) -> DataFrame:
    """(shard, grown_shard, n): how many rows of ``place``'s result move between which shards."""
    return (
        before.where("shard <> grown_shard").groupBy("shard", "grown_shard").agg(F.count("*").alias("n"))
    )


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law ``key``, and where each is with 25."""
    found = place(documents(spark, sf_dir), even_tree(SHARDS), even_tree(SHARDS + 1))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def brute_shard(key, tree: tuple[Leaf, ...]) -> int:
    """The same draw by draw, for tests."""
    below, node = children(tree), ""
    for _ in range(_LEVELS):
        draws = []
        for name, weight in below[node]:
            h = xxhash.xxh64(f"{name} {'null' if key is None else key}".encode(), seed=42).intdigest()
            draws.append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / weight, name))
        node = min(draws)[1]
    return int(node.rsplit("/", 1)[1])

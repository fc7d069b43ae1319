"""Sharding by a hierarchical weighted hash tree.

Every row descends from region to rack to shard.  At each level each child draws ``-ln(u) / weight``
with ``u`` a hash of the row's key and the child's name, and the least draw wins, so children are
chosen in proportion to their weights.  A draw depends on nothing but the key, the child's name and
the child's weight: when a weight changes, rows move into or out of the subtrees on the path to it
and no others.  A shard added as a region of its own takes rows only into itself.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; only shards carry a number and a weight of their own."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own: float = 0.0

    @property
    def weight(self) -> float:
        return self.own if not self.children else sum(c.weight for c in self.children)


def shard_node(number: int, weight: float = 1.0) -> Node:
    return Node(f"shard{number}", shard=number, own=weight)


def tree_of(shards: int, base: int = 8) -> Node:
    """The tree for a number of shards: ``base`` shards in two racks of each of two regions, then one region per further shard.

    Any number from ``base`` on extends the smaller trees, so growing by one moves rows only into the
    new shard.  Below ``base`` every shard is a region of its own.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    regions: list[Node] = []
    if shards >= base and base % 4 == 0:
        per = base // 4
        for region in range(2):
            racks = tuple(
                Node(f"r{region}.k{rack}", tuple(shard_node((2 * region + rack) * per + i) for i in range(per)))
                for rack in range(2)
            )
            regions.append(Node(f"r{region}", racks))
    first = base if regions else 0
    for number in range(first, shards):
        regions.append(Node(f"solo{number}", (Node(f"solo{number}.k0", (shard_node(number),)),)))
    return Node("root", tuple(regions))


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of a child for a key: 52 bits of MD5 of "key/name" as ``u`` in (0, 1], ``-ln(u) / weight``."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, F.lit(name)).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(1)) / F.lit(float(2**52))) / F.lit(float(weight))


def descend(key: Column, node: Node) -> Column:
    """The shard number a key reaches; children without weight take nothing."""
    children = [c for c in node.children if c.weight > 0]
    if not node.children:
        return F.lit(node.shard)
    if not children:
        raise ValueError(f"{node.name} has no weight")
    if len(children) == 1:
        return descend(key, children[0])
    draws = F.array(*[F.struct(draw(key, c.name, c.weight).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children)])
    won = F.array_min(draws)["i"]
    choice = F.when(won == 0, descend(key, children[0]))
    for i, child in enumerate(children[1:], 1):
        choice = choice.when(won == i, descend(key, child))
    return choice


def key_of(column: str) -> Column:
    """The key as text; a null key is the empty text, which no number prints as."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def assign(df: DataFrame, tree: Node, *, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Adds the shard of every row; an existing column of that name is replaced."""
    return df.withColumn(out, descend(key_of(key), tree).cast("int"))


def with_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Gapless positions from 0 in each shard by ``order``, without a task that holds a whole shard.

    Rows are dealt by ranges of the order into a table, numbered inside each (range, shard), and the
    counts of the ranges before are added.  Rows equal in all of ``order`` get slots in no set order.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "slots")
    counts = ranged.groupBy("_range", shard).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range", shard).orderBy(*order)))
    return (
        numbered.join(offsets, ["_range", shard])
        .withColumn(out, (F.col("_before") + F.col("_at") - 1).cast("long"))
        .drop("_range", "_before", "_at")
    )


def place(df: DataFrame, shards: int = 8, *, tree: Node | None = None, grown: Node | None = None) -> DataFrame:
    """Shard, slot and the shard after growth for every row of ``df(doc_id, text)``.

    Result: doc_id, size (UTF-8 bytes plus 1; a null text has no bytes), text_crc32 (unsigned, null as
    empty), law (``key``), shard, slot, grown_shard.  Repeated rows and null ids are rows like any
    other: equal ids share a shard.  An empty table gives an empty result; other columns are ignored.
    """
    tree = tree or tree_of(shards)
    grown = grown or tree_of(shards + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = df.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign(assign(narrow, tree), grown, out="grown_shard")
    slotted = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def sql_descend(key: str, node: Node) -> str:
    """The shard number of a key as SQL."""
    children = [c for c in node.children if c.weight > 0]
    if not node.children:
        return str(node.shard)
    if len(children) == 1:
        return sql_descend(key, children[0])
    draws = ", ".join(
        f"{{d: -ln((('0x' || substr(md5({key} || '/{c.name}'), 1, 13))::BIGINT + 1) / {2**52}.0::DOUBLE) / {c.weight}, i: {i}}}"
        for i, c in enumerate(children)
    )
    cases = " ".join(f"WHEN {i} THEN {sql_descend(key, c)}" for i, c in enumerate(children))
    return f"CASE list_min([{draws}]).i {cases} END"


#: crc32 of a text's UTF-8 bytes in SQL: the byte table is built from its rule, the bytes are folded one by one.
SQL_CRC = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i))
),
summed AS (
  SELECT documents.*, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table
)"""


def oracle(shards: int = 8) -> str:
    """The same in SQL; logarithms of two engines may differ in the last bit, which no two draws here are near."""
    key = "coalesce(CAST(doc_id AS VARCHAR), '')"
    return f"""
WITH {SQL_CRC},
placed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, text_crc32,
    {sql_descend(key, tree_of(shards))} AS shard, {sql_descend(key, tree_of(shards + 1))} AS grown_shard
  FROM summed
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""

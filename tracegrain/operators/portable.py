"""Portable exports: Merkle trees over entries, and erasable payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordered import row_numbers
from ..session import cut

BLOCK_LEVELS = 12  # one task folds at most 2 ** 12 nodes


def _fold_blocks(level_rows: DataFrame, level: int) -> DataFrame:
    """Nodes (level, idx, hash) of BLOCK_LEVELS levels above aligned blocks of nodes, the blocks' own nodes included."""
    joined = lambda a, b: F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(a), F.unhex(b)), 256)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda n: n["hash"])
    rows = level_rows.groupBy(F.shiftright("idx", BLOCK_LEVELS).alias("block")).agg(in_order.alias("n0"))

    def above(below: str) -> Column:
        def parent(i):
            left, right = F.get(below, 2 * i), F.get(below, 2 * i + 1)
            return F.when(right.isNull(), left).otherwise(joined(left, right))  # an unpaired node is carried up

        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)), parent)

    def placed(step: int) -> Column:
        first = F.shiftleft("block", BLOCK_LEVELS - step)
        return F.transform(f"n{step}", lambda h, i: F.struct(F.lit(level + step).alias("level"), (first + i).alias("idx"), h.alias("hash")))

    for step in range(BLOCK_LEVELS):
        rows = rows.withColumn(f"n{step + 1}", above(f"n{step}"))
    return rows.select(F.inline(F.concat(*[placed(step) for step in range(BLOCK_LEVELS + 1)])))


def merkle_nodes(entries: DataFrame, order: list[str], content: Column) -> tuple[DataFrame, DataFrame]:
    """All tree nodes (level, idx, hash) and the numbered leaves (order columns, idx).

    Aligned blocks of 4096 nodes fold apart and give 12 levels at once; a table of n entries needs
    log2(n) / 12 rounds, and only block roots move between rounds.
    """
    leaf = entries.select(*order, F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(content, "UTF-8")), 256).alias("hash")).withColumn("_tree", F.lit(0))
    leaves = cut(row_numbers(leaf, ["_tree"], order, out="_n").select(*order, "hash", (F.col("_n") - 1).alias("idx")))
    size = leaves.agg(F.max("idx").alias("m")).first()["m"]
    if size is None:
        raise ValueError("a tree needs at least one entry")
    level_rows, nodes, level = leaves.select(F.lit(0).alias("level"), "idx", "hash"), None, 0
    while True:
        made = cut(_fold_blocks(level_rows.select("idx", "hash"), level))
        nodes = made if nodes is None else nodes.unionByName(made.filter(F.col("level") > level))
        level += BLOCK_LEVELS
        size >>= BLOCK_LEVELS
        if size == 0:
            return nodes, leaves
        level_rows = made.filter(F.col("level") == level)


def merkle_root(nodes: DataFrame) -> DataFrame:
    """Hash of the node at idx 0 of the highest level."""
    return nodes.filter("idx = 0").agg(F.max_by("hash", "level").alias("root"))


def inclusion_proofs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Siblings from leaf to root per leaf idx: (idx, level, side, sibling); a carried node has none at that level."""
    top = nodes.agg(F.max("level").alias("m")).scalar()
    path = leaves.select("idx", top.alias("_top")).filter("_top > 0").select("idx", F.explode(F.sequence(F.lit(0), F.col("_top") - 1)).alias("level"))
    path = path.withColumn("_node", F.expr("shiftright(idx, level)")).withColumn("_sib", F.col("_node").bitwiseXOR(F.lit(1).cast("bigint")))
    side = F.when(F.col("_node") % 2 == 0, "R").otherwise("L")
    siblings = nodes.select("level", F.col("idx").alias("_sib"), F.col("hash").alias("sibling"))
    return path.withColumn("side", side).join(siblings, ["level", "_sib"]).select("idx", "level", "side", "sibling")


def verify_inclusion(leaves: DataFrame, proofs: DataFrame, root: DataFrame) -> DataFrame:
    """Fold each leaf with its at most 64 siblings and compare with the root."""
    steps = proofs.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("level", "side", "sibling"))).alias("_p"))
    node = lambda a, b: F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(a), F.unhex(b)), 256)
    climbed = F.aggregate(F.coalesce("_p", F.array().cast("array<struct<level:int,side:string,sibling:string>>")), F.col("hash"),
                          lambda h, s: F.when(s["side"] == "L", node(s["sibling"], h)).otherwise(node(h, s["sibling"])))
    return leaves.select("idx", "hash").join(steps, "idx", "left").select("idx", (climbed == root.select("root").scalar()).alias("included"))


FORGOTTEN = "[FORGOTTEN]"


def encrypt_payloads(events: DataFrame, keys: DataFrame, row_id: str) -> DataFrame:
    """Payload replaced by an AES-GCM cell under the row's own key (keys: row id, key of 16 or 32 bytes).

    The nonce follows from key and row, and a key serves one row only, so a recomputed task seals the same bytes.
    """
    nonce = F.unhex(F.substring(F.sha2(F.concat(F.col("key"), F.encode(F.col(row_id).cast("string"), "UTF-8")), 256), 1, 24))
    cell = F.base64(F.aes_encrypt(F.encode("payload", "UTF-8"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), nonce))
    return events.join(keys, row_id).withColumn("payload", cell).drop("key")


def read_payloads(events: DataFrame, keys: DataFrame, row_id: str) -> DataFrame:
    """Plain payloads where the key still exists, the sentinel where it was erased."""
    plain = F.decode(F.try_aes_decrypt(F.unbase64("payload"), F.col("key"), F.lit("GCM")), "UTF-8")
    return events.join(keys, row_id, "left").withColumn("payload", F.coalesce(plain, F.lit(FORGOTTEN))).drop("key")


def erase(keys: DataFrame, forgotten: DataFrame, row_id: str) -> DataFrame:
    """The key table without the forgotten rows' keys."""
    return keys.join(forgotten.select(row_id), row_id, "left_anti")

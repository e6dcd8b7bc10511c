"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual`` points of a ring of 2^32 positions; a key belongs to the first point clockwise from its hash.
A shard holds at most its capacity in rows; keys overflowing a full shard continue clockwise to the next other
shard. With a slack of 0 the capacities add up to the number of rows (counts at most one apart); with more slack
fewer keys move when a shard is added.

Overflow would be sequential row by row. Here the ring's arcs are cut into cells, only the cells' row counts (a number fixed by
parameters, never by keys) reach the driver, and the plan for whole runs of ranks within cells is
made there in rounds: in each, every shard takes the pending runs whose next stop it is, in ring order, up to its
capacity; a run may be split at a rank. Rows then look their shard and slot up by cell and rank, a
window over one cell. Repeated keys share a position; a hash of the row's content cuts cells once more, and
fully equal rows travel as one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored

RING = 1 << 32
#: Cells reach the driver: at most (shards * virtual + 1) * (MOST_CUTS + 1) * SALTS rows.
MOST_CUTS, SALTS = 16, 16
#: Copies of one row made from one row at a time.
EXPAND = 10_000


@dataclass(frozen=True)
class Ring:
    shards: int = 8
    virtual: int = 64
    slack: float = 0.0
    seed: int = 3
    cell_rows: int = 20_000


def points(ring: Ring) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes, clockwise. A shard's points depend on its number only."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"{ring.seed}|{s}|{v}".encode()).digest()[:4], "big")
    return sorted((at(s, v), s) for s in range(ring.shards) for v in range(ring.virtual))


def position(key: Column, ring: Ring) -> Column:
    return F.xxhash64(F.lit(ring.seed), key).bitwiseAND(F.lit(RING - 1).cast("long"))


def capacities(rows: int, ring: Ring) -> list[int]:
    if ring.slack:
        return [int(-(-rows * (1 + ring.slack) // ring.shards))] * ring.shards
    return [rows // ring.shards + (s < rows % ring.shards) for s in range(ring.shards)]


def stops(ring: Ring) -> list[list[int]]:
    """For each arc (the keys before a point, after the last one) the distinct shards clockwise."""
    owners = [s for _, s in points(ring)]
    out = []
    for k in range(len(owners) + 1):
        out.append(list(dict.fromkeys(owners[k:] + owners[:k])))
    return out


def plan(counts: list[tuple[int, int, int]], ring: Ring) -> list[tuple[int, int, int, int]]:
    """Runs (cell, first rank, shard, first slot) for (cell, arc, rows) in ring order."""
    route = stops(ring)
    room = capacities(sum(n for _, _, n in counts), ring)
    slot = [0] * ring.shards
    pending = [(cell, arc, 0, n) for cell, arc, n in counts if n]
    out = []
    for turn in range(ring.shards):
        left = []
        for cell, arc, lo, hi in pending:
            s = route[arc][turn]
            take = min(hi - lo, room[s])
            if take:
                out.append((cell, lo, s, slot[s]))
                slot[s] += take
                room[s] -= take
            if take < hi - lo:
                left.append((cell, arc, lo + take, hi))
        pending = left
    assert not pending
    return sorted(out)


def _with_cell(rows: DataFrame, ring: Ring, total: int) -> DataFrame:
    """Adds _arc (bisection over the points, one comparison a step), _grid (even cuts of the ring) and _cut (a content hash)."""
    marks = [p for p, _ in points(ring)]
    cuts = min(MOST_CUTS, max(1, -(-total // (ring.cell_rows * len(marks)))))
    width = max(1, RING // (len(marks) * cuts))
    grid = F.array(*[F.lit(m).cast("long") for m in marks])
    rows = rows.withColumn("_arc", F.lit(0))
    step = 1 << (len(marks).bit_length() - 1)
    while step:
        there = F.get(grid, F.col("_arc") + step - 1) < F.col("_position")
        rows = rows.withColumn("_arc", F.when(F.coalesce(there, F.lit(False)), F.col("_arc") + step).otherwise(F.col("_arc")))
        step //= 2
    rows = rows.withColumn("_grid", F.floor(F.col("_position") / width).cast("long"))
    return rows.withColumn("_cut", F.pmod(F.xxhash64("text_crc32", "size", "doc_id"), F.lit(SALTS)).cast("int"))


def shard(docs: DataFrame, ring: Ring = Ring(), key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text) under the law ``rows``.

    size is the text's UTF-8 bytes plus 1; null texts count as empty. Slots run from 0 without gaps in each shard. A cell's
    rows are ordered by their hash, then the key, the checksum and the size; rows equal in all of these are
    interchangeable and are carried as one row with a count until the end. Null keys hash like any key. Other
    columns are ignored. An empty table gives an empty result. grown_shard is null: with bounded loads a new shard may
    also move overflow between old ones.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_copies"))
    rows = stored(rows.withColumn("_position", position(F.col("doc_id"), ring)), "ring")
    total = rows.agg(F.sum("_copies")).first()[0] or 0
    rows = _with_cell(rows, ring, total)
    cell = ["_arc", "_grid", "_cut"]
    found = rows.groupBy(*cell).agg(F.sum("_copies").alias("n")).orderBy(*cell).collect()
    by_cell: dict[int, list[tuple[int, int, int]]] = {}
    for k, lo, s, slot in plan([(k, r._arc, r.n) for k, r in enumerate(found)], ring):
        by_cell.setdefault(k, []).append((lo, s, slot))
    table = docs.sparkSession.createDataFrame([(r._arc, r._grid, r._cut, by_cell[k]) for k, r in enumerate(found)], "_arc int, _grid long, _cut int, _runs array<struct<lo:long,shard:int,slot:long>>")
    before = Window.partitionBy(*cell).orderBy("_position", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_rank", F.coalesce(F.sum("_copies").over(before), F.lit(0).cast("long"))).join(table, cell)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / EXPAND)))
    single = ranked.where("_copies = 1")
    copies = ranked.where("_copies > 1").withColumn("_block", block).repartition("_rank", "_block")
    copies = copies.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(EXPAND - 1).cast("long"), F.col("_copies") - F.col("_block") * EXPAND - 1))))
    copies = copies.withColumn("_rank", F.col("_rank") + F.col("_block") * EXPAND + F.col("_k")).drop("_block", "_k")
    run = F.element_at(F.filter("_runs", lambda x: x["lo"] <= F.col("_rank")), -1)
    out = single.unionByName(copies).withColumn("_run", run)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_run.shard").alias("shard"), (F.col("_run.slot") + F.col("_rank") - F.col("_run.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

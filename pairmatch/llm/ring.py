"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from bisect import bisect_left
from hashlib import sha256

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.llm.text import text_of
from pairmatch.session import written

#: The ring has this many cells; every virtual node sits in a cell of its own.
CELL_BITS = 16
VIRTUAL_NODES = 512


def ring_marks(shards: int, vnodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """``(cell, shard)`` of every virtual node in ring order.

    A node takes the next free cell if its own is taken. Nodes are set shard by shard, so a
    further shard moves none of the earlier ones.
    """
    cells = 1 << CELL_BITS
    if shards * vnodes > cells // 2:
        raise ValueError("too many virtual nodes for the ring")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(vnodes):
            cell = int.from_bytes(sha256(f"{shard}:{node}".encode()).digest()[:8]) % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: (1 + slack) times the mean, with no slack exactly all rows."""
    if slack:
        return [int((1 + slack) * rows / shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def bounded_loads(
    counts: dict[int, int], marks: list[tuple[int, int]], room: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each cell go: ``(cell, start, stop, shard, slot)``.

    Rows take their place in ring order. A row goes to the shard of the first node at or after
    its cell; if that shard is full it continues clockwise. The work depends on the number of
    cells and nodes alone, not on the number of rows.
    """
    room, used, pieces = list(room), [0] * len(room), []
    places = [cell for cell, _ in marks]
    for cell in sorted(counts):
        start, left, node = 0, counts[cell], bisect_left(places, cell)
        while left:
            shard = marks[node % len(marks)][1]
            take = min(left, room[shard])
            if take:
                pieces.append((cell, start, start + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                start += take
                left -= take
            node += 1
    return pieces


def ring_shards(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    vnodes: int = VIRTUAL_NODES,
    slack: float = 0.0,
) -> DataFrame:
    """Put every row into a shard: ``(doc_id, size, text_crc32, home, shard, slot)``.

    The place of a row on the ring is a hash of id and text; ``home`` is the shard of the next
    virtual node clockwise, ``shard`` the first one clockwise that is not full. Without slack
    the shards' row counts differ by at most one. ``slot`` counts the rows of a shard from 0
    without gaps. ``size`` is the UTF-8 length plus 1.

    Texts are read once and never shuffled: what moves are narrow rows, to number those of a
    cell. The driver sees one count per cell, at most 2**16, whatever the number of rows; the
    table it sends back is bounded by cells and shards and is broadcast.

    A null text has size 1 and the checksum of an empty one; a null id is a value like any
    other. Rows that agree in id and text are interchangeable and fill neighbouring slots. Other
    columns are not looked at. An empty table gives an empty result.
    """
    text = text_of("text")
    place = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("place"),
    )
    cell = F.shiftrightunsigned("place", 64 - CELL_BITS).cast("int")
    inside = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = written(
        place.withColumn("cell", cell).select(
            "doc_id", "size", "text_crc32", "cell",
            (F.row_number().over(inside) - 1).cast("long").alias("rank"),
        ),
        "ring",
    )
    counts = dict(ranked.groupBy("cell").agg(F.count("*")).collect())
    marks = ring_marks(shards, vnodes)
    places = [c for c, _ in marks]
    pieces = [
        (*piece, marks[bisect_left(places, piece[0]) % len(marks)][1])
        for piece in bounded_loads(counts, marks, capacities(sum(counts.values()), shards, slack))
    ]
    table = docs.sparkSession.createDataFrame(
        pieces, "cell int, start long, stop long, shard int, slot0 long, home int"
    )
    inside_piece = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
    return (
        ranked.join(F.broadcast(table), "cell")
        .where(inside_piece)
        .select(
            "doc_id", "size", "text_crc32", "home", "shard",
            (F.col("slot0") + F.col("rank") - F.col("start")).alias("slot"),
        )
    )

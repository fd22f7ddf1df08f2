"""Products of a sparse table of documents and terms with itself, tile by tile.

The terms are dealt into blocks; a tile is what two blocks have in common. The entries of a block
are sent to its tiles in packed form and multiplied there, so no product is shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.text import ngrams
from pairmatch.operators.joins import hot_keys, salted_join
from pairmatch.session import written

#: Entries (a term in a document) of a block of terms. A task holds two blocks.
BLOCK = 6 << 20
#: Entries that are packed at a time, and products that are summed up at a time.
FLUSH = 1 << 20
PRODUCTS = 1 << 20
#: Spreads the numbers of terms over the blocks.
STEP = np.uint64(0x9E3779B97F4A7C15)


def document_terms(docs: DataFrame, max_n: int) -> DataFrame:
    """``(doc, term, n, partners, total, most)``: the counts of each document, a row per term.

    ``partners`` counts the other terms of the document, ``total`` and ``most`` are the sum and the
    largest of the products of their counts with the term's. Nulls are no terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            pairs = pa.table({"doc": pc.take(batch.column(0), pc.list_parent_indices(lists)),
                              "term": pc.list_flatten(lists)}).drop_null()
            counts = pairs.group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
            if not counts.num_rows:
                continue
            n = counts["count_all"].to_numpy()
            _, at = np.unique(counts["doc"].to_numpy(), return_inverse=True)
            order = np.lexsort((n, at))
            last = np.flatnonzero(np.diff(at[order], append=-1))
            size = np.bincount(at)
            everything = np.zeros(len(size), np.int64)
            np.add.at(everything, at, n)
            # the largest count of another term: that of the last, for the last that of the one before
            other = n[order][last][at]
            other[order[last]] = np.where(size > 1, n[order][last - 1], 0)
            arrays = (size[at] - 1, n * (everything[at] - n), n * other)
            out = pa.table(
                [counts["doc"], counts["term"], counts["count_all"], *map(pa.array, arrays)],
                names=["doc", "term", "n", "partners", "total", "most"],
            )
            yield from out.to_batches(max_chunksize=1 << 16)

    terms = docs.select(
        F.monotonically_increasing_id().alias("doc"), ngrams(F.col("tokens"), max_n).alias("terms")
    )
    schema = "doc long, term string, n long, partners long, total long, most long"
    return terms.mapInArrow(run, schema)


def numbered_terms(counts: DataFrame) -> DataFrame:
    """``(term, id, docs, partners, total, most)``: sums (and the largest) over ``document_terms``.

    A partner counts once for each document, so ``partners`` is exact for a term of one document and
    a bound for others; so is ``most``, from below.
    """
    sums = counts.groupBy("term").agg(
        F.count("*").alias("docs"), F.sum("partners").alias("partners"),
        F.sum("total").alias("total"), F.max("most").alias("most"),
    )
    return written(sums.withColumn("id", F.monotonically_increasing_id()), "terms")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as the bytes of their differences, all first bytes first, compressed."""
    planes = np.diff(numbers, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = pa.decompress(data, 8 * size, "zstd", asbytes=True)
    flat = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T)
    return np.cumsum(flat.view(np.int64).reshape(-1))


def tiles(counts: DataFrame, terms: DataFrame, least: int, block: int) -> DataFrame:
    """``(p, q, at, size, id, doc, n)``: the packed entries of two blocks of terms, p <= q.

    Entries of terms of ``least`` documents or more are looked at. There are as many blocks as it
    takes for each to hold about ``block`` entries, and enough for all cores to have tiles.
    """
    used = terms.where(F.col("docs") >= least)
    entries = used.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    cores = counts.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-entries // block), int(np.ceil(np.sqrt(8 * cores))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append(batch)
            total += batch.num_rows
            if total >= FLUSH:
                yield blobs(held)
                held, total = [], 0
        if total:
            yield blobs(held)

    def blobs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, docs, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "doc", "n"))
        at = ((ids.view(np.uint64) * STEP) >> np.uint64(32)).astype(np.int64) % blocks
        order = np.lexsort((docs, ids, at))
        found, starts = np.unique(at[order], return_index=True)
        parts = np.split(order, starts[1:])
        columns = [pa.array([packed(x[p]) for p in parts], pa.binary()) for x in (ids, docs, n)]
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array([len(p) for p in parts], pa.int64()), *columns],
            names=["at", "size", "id", "doc", "n"],
        )

    hot = hot_keys(terms.select("term", F.col("docs").alias("n")), ["term"])
    rows = salted_join(counts.select("doc", "term", "n"), used.select("term", "id"), ["term"], hot, F.col("doc"))
    parts = rows.select("id", "doc", "n").mapInArrow(pack, "at int, size long, id binary, doc binary, n binary")
    met = parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.select(
        F.least("at", "with").alias("p"), F.greatest("at", "with").alias("q"), "at", "size", "id", "doc", "n"
    ).repartition(min(blocks * (blocks + 1) // 2, 32 * cores), "p", "q")


class Entries:
    """The entries of one block, in the order of terms; ``own`` numbers its terms 0, 1, ..."""

    def __init__(self, rows: list[dict], at: int):
        parts = [r for r in rows if r["at"] == at]
        ids, doc, n = (
            np.concatenate([unpacked(r[c], r["size"]) for r in parts] or [np.zeros(0, np.int64)])
            for c in ("id", "doc", "n")
        )
        order = np.argsort(ids, kind="stable")
        first = np.diff(ids[order], prepend=-1) > 0
        self.terms, self.own = ids[order][first], np.cumsum(first, dtype=np.int32) - np.int32(1)
        self.doc, self.n = doc[order], n[order].astype(np.int32 if n.max(initial=0) < 1 << 31 else np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ``n`` for each key; both are sorted in one number where they fit."""
    bits = int(n.max(initial=0)).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits < 64:
        both = np.sort(keys << bits | n)
        keys, n = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(n, starts) if len(n) else n


def both_blocks(batches: Iterator[pa.RecordBatch]) -> tuple[Entries, Entries]:
    """The two blocks of a tile; the same one twice on the diagonal."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    p, q = rows[0]["p"], rows[0]["q"]
    left = Entries(rows, p)
    return left, left if p == q else Entries(rows, q)


def places(left: Entries, right: Entries) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of ``left``, the first entry of ``right`` of its document and their number."""
    docs, counts = np.unique(right.doc, return_counts=True)
    starts = np.append(np.cumsum(counts) - counts, 0)
    docs, counts = np.append(docs, -1), np.append(counts, 0).astype(np.int32)
    at = np.searchsorted(docs[:-1], left.doc).astype(np.int32)
    at[docs[at] != left.doc] = len(docs) - 1
    return starts.astype(np.int32)[at], counts[at]


def products(left: Entries, right: Entries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The cells of a tile, some rows at a time: ``(row, column, n)`` by the blocks' own numbers.

    On the diagonal a pair of terms is found from both sides; a term does not meet itself.
    """
    order = np.argsort(right.doc, kind="stable")
    own, n = right.own[order], right.n[order]
    starts, sizes = places(left, right)
    # whole rows go together, as many as have about PRODUCTS products
    ends = np.flatnonzero(np.diff(left.own, append=-1)) + 1
    done = np.cumsum(sizes)[ends - 1]
    cuts = ends[np.flatnonzero(np.diff(done // PRODUCTS, append=-1))].tolist()
    for x, y in zip([0, *cuts], cuts):
        some = sizes[x:y]
        each = np.repeat(np.arange(x, y), some)
        at = np.arange(len(each)) + np.repeat(starts[x:y] - np.cumsum(some) + some, some)
        keys = (left.own[each] - left.own[x]) * np.int64(len(right.terms)) + own[at]
        keys, cells = summed(keys, left.n[each] * n[at].astype(np.int64))
        row, column = np.divmod(keys, max(len(right.terms), 1))
        row += left.own[x]
        if left is right:
            other = row != column
            row, column, cells = row[other], column[other], cells[other]
        if len(row):
            yield row, column, cells


def tile_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(i, j, n)``: the cells of a tile, each pair of two terms once."""
    left, right = both_blocks(batches)
    for row, column, n in products(left, right):
        once = row < column if left is right else slice(None)
        out = pa.table({"i": left.terms[row[once]], "j": right.terms[column[once]], "n": n[once]})
        yield from out.to_batches(max_chunksize=1 << 16)


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, again, most)``: what the cells of a tile say about its terms.

    ``again`` is by how much the partners of a term, counted in each document, are more than its
    different ones; ``most`` is its largest cell.
    """
    left, right = both_blocks(batches)
    sides = [(left, right)] if left is right else [(left, right), (right, left)]
    again = []
    for a, b in sides:
        met = places(a, b)[1] - (left is right)
        firsts = np.flatnonzero(np.diff(a.own, prepend=-1))
        again.append(np.add.reduceat(met, firsts, dtype=np.int64) if len(firsts) else np.zeros(0, np.int64))
    most = [np.zeros(len(a.terms), np.int64) for a, _ in sides]
    for row, column, n in products(left, right):
        for k, place in enumerate((row, column)[: len(sides)]):
            again[k] -= np.bincount(place, minlength=len(again[k]))
            np.maximum.at(most[k], place, n)
    for (a, _), x, y in zip(sides, again, most):
        yield pa.RecordBatch.from_pydict({"id": a.terms, "again": x, "most": y})

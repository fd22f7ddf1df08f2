"""Lines that many documents share: an index that takes documents in and gives them back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.cuckoo import CuckooFilter, buckets_for
from pairmatch.llm.text import SPACES, text_of
from pairmatch.operators.joins import lookup_join
from pairmatch.session import written

#: Bytes of all filters up to which they are sent to the tasks; beyond, lines are joined.
MOST_SENT = 1 << 26
#: Rows of exact tables up to which they are broadcast; beyond, they are joined with salts.
MOST_BROADCAST = 1_000_000
COUNTS = "shard int, h1 long, h2 long, n long"
FILTERS = "shard int, buckets long, held long, prints binary"


def lines_of(text: Column) -> Column:
    """The lines of a text, as they are."""
    return F.split(text, "\n", -1)


def key_of(line: Column, folded: bool = False) -> Column:
    """A line without white space at both ends and, unless the text was, with A-Z lower-cased."""
    return F.btrim(line if folded else fold(line), F.lit(SPACES))


def fold(text: Column) -> Column:
    """A-Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def names_of(key: Column) -> list[Column]:
    """Two 64-bit hashes that together name a key (128 bits)."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def shard_of(shards: int) -> Column:
    """The shard of a key: one of ``shards``, by its first hash."""
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")


def line_counts(docs: DataFrame, shards: int, text_col: str = "text", least: int = 1) -> DataFrame:
    """``(shard, h1, h2, n)``: in how many rows each line key occurs; partial sums come first."""
    keys = F.transform(lines_of(fold(text_of(text_col))), lambda x: key_of(x, folded=True))
    key = F.explode(F.array_distinct(keys)).alias("key")
    names = docs.select(key).where(F.length("key") >= least).select(*names_of(F.col("key")))
    return names.groupBy("h1", "h2").agg(F.count("*").alias("n")).select(
        shard_of(shards), "h1", "h2", "n"
    )


def built(common: DataFrame) -> DataFrame:
    """The filter of each shard over the keys ``(shard, h1)``."""

    def build(table: pa.Table) -> pa.Table:
        hashes = table["h1"].to_numpy().view(np.uint64)
        buckets = buckets_for(len(hashes))
        made = CuckooFilter(buckets)
        while not made.add(hashes):
            buckets *= 2
            made = CuckooFilter(buckets)
        return filter_rows([(table["shard"][0].as_py(), buckets, len(hashes), made)])

    return common.select("shard", "h1").groupBy("shard").applyInArrow(build, FILTERS)


def filter_rows(rows: list[tuple[int, int, int, CuckooFilter]]) -> pa.Table:
    """A table of filters."""
    return pa.table(
        {
            "shard": pa.array([r[0] for r in rows], pa.int32()),
            "buckets": pa.array([r[1] for r in rows], pa.int64()),
            "held": pa.array([r[2] for r in rows], pa.int64()),
            "prints": pa.array([r[3].tobytes() for r in rows], pa.binary()),
        }
    )


@dataclass(frozen=True)
class LineIndex:
    """In how many documents each line occurs, and which lines ``min_docs`` or more share.

    ``generations`` are written tables of counts ``(shard, h1, h2, n)``, one for each insertion
    and, with negative counts, each deletion; their sum is the exact reference count of every
    line. ``filters`` has one cuckoo filter per shard of the keys that are common now. An index
    never changes: ``insert`` and ``delete`` return another one that shares what stays the same,
    so a failed update leaves the old one as it was.
    """

    spark: SparkSession
    min_docs: int = 10
    least: int = 1  # code points of a key; shorter ones are not indexed
    shards: int = 64
    generations: tuple[DataFrame, ...] = ()
    filters: DataFrame | None = None

    def totals(self) -> DataFrame:
        """``(shard, h1, h2, n)`` with the exact reference counts above zero."""
        if len(self.generations) == 1:
            return self.generations[0]
        rows = self.spark.createDataFrame([], COUNTS)
        for generation in self.generations:
            rows = rows.unionByName(generation)
        summed = rows.groupBy("shard", "h1", "h2").agg(F.sum("n").alias("n"))
        return summed.where("n != 0").select("shard", "h1", "h2", "n")

    def common(self) -> DataFrame:
        """The keys that are found in ``min_docs`` documents or more."""
        return self.totals().where(F.col("n") >= self.min_docs)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Take in the lines of documents; each row is a document."""
        return self._changed(line_counts(docs, self.shards, text_col, self.least))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Give back documents that were inserted before, with their texts as they were."""
        counts = line_counts(docs, self.shards, text_col, self.least)
        return self._changed(counts.withColumn("n", -F.col("n")))

    def merge(self) -> LineIndex:
        """One table of counts instead of many; the filters stay."""
        return replace(self, generations=(written(self.totals(), "line-counts"),))

    def _changed(self, delta: DataFrame) -> LineIndex:
        delta = written(delta, "line-counts")
        if not self.generations:
            if not delta.where("n < 0").isEmpty():
                raise ValueError("documents were deleted that are not in the index")
            first = replace(self, generations=(delta,))
            return replace(first, filters=written(built(first.common()), "line-filters"))
        # exact counts before and after, of the keys that change
        moved = written(
            self.totals()
            .join(delta.withColumnRenamed("n", "delta"), ["shard", "h1", "h2"], "right")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
            .select("shard", "h1", "h2", "n", (F.col("n") + F.col("delta")).alias("after")),
            "line-changes",
        )
        if not moved.where("after < 0").isEmpty():
            raise ValueError("documents were deleted that are not in the index")
        was, will = F.col("n") >= self.min_docs, F.col("after") >= self.min_docs
        crossed = moved.where(was != will).select("shard", "h1", will.alias("comes"))
        after = replace(self, generations=(*self.generations, delta))
        return replace(after, filters=written(after._refilled(crossed), "line-filters"))

    def _refilled(self, crossed: DataFrame) -> DataFrame:
        """The filters after some keys came and others went; those too small are built anew."""

        def update(old: pa.Table, keys: pa.Table) -> pa.Table:
            if not len(old) or not len(keys):
                return old
            shard, buckets, held, prints = (old[c][0].as_py() for c in old.column_names)
            now = CuckooFilter(buckets, prints)
            hashes, comes = keys["h1"].to_numpy().view(np.uint64), keys["comes"].to_numpy()
            now.remove(hashes[~comes])
            held += 2 * int(comes.sum()) - len(comes)
            if buckets_for(held) > buckets or not now.add(hashes[comes]):
                return filter_rows([])
            return filter_rows([(shard, buckets, held, now)])

        kept = written(
            self.filters.groupBy("shard")
            .cogroup(crossed.groupBy("shard"))
            .applyInArrow(update, FILTERS),
            "line-filters",
        )
        missing = self.common().join(kept.select("shard"), "shard", "left_anti")
        return kept.unionByName(built(missing))

    def sent(self) -> dict[int, tuple[int, bytes]] | None:
        """All filters if they take ``MOST_SENT`` bytes at most."""
        size = self.filters.agg(F.sum(F.octet_length("prints"))).first()[0] or 0
        if size > MOST_SENT:
            return None
        rows = self.filters.select("shard", "buckets", "prints").collect()
        return {r["shard"]: (r["buckets"], bytes(r["prints"])) for r in rows}

    def common_lines(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``(t1, t2, h1, h2)``: the different texts, by name, and the common keys in each.

        The filters rule out nearly all lines where they are read; the rest is looked up in the
        exact table. If the filters are too large to send, all lines are looked up.
        """
        keys = F.transform(lines_of(fold(text_of(text_col))), lambda x: key_of(x, folded=True))
        lines = docs.select(*text_names(text_col), F.array_distinct(keys).alias("keys")).select(
            "t1", "t2",
            F.transform("keys", lambda x: F.xxhash64(x)).alias("a1"),
            F.transform("keys", lambda x: F.xxhash64(F.lit(1), x)).alias("a2"),
        )
        filters = self.sent()
        if filters is not None:
            lines = probed(lines, self.spark.sparkContext.broadcast(filters), self.shards)
        held = (
            lines.select("t1", "t2", F.explode(F.arrays_zip("a1", "a2")).alias("x"))
            .select("t1", "t2", F.col("x.a1").alias("h1"), F.col("x.a2").alias("h2"))
            .distinct()
        )
        common = self.common()
        return lookup_join(
            held, common.select("h1", "h2"), ["h1", "h2"], common, F.col("t1"), most=MOST_BROADCAST
        )

    def drop(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Every row without its common lines: ``(doc_id, n_lines, n_dropped, kept, kept_sha256)``.

        All lines with a common key go, in every document; the others stay as they are, joined
        by line ends. A null or empty text is one empty line. Rows with equal or null ids are
        treated each by its own text; other columns are not looked at.
        """
        lines = written(self.common_lines(docs, text_col), "common-lines")
        gone = written(
            lines.groupBy("t1", "t2").agg(
                F.collect_list("h1").alias("g1"), F.collect_list("h2").alias("g2")
            ),
            "dropped-lines",
        )
        rows = docs.select(
            F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *text_names(text_col)
        )
        # sent whole only if its lists are short together
        most = MOST_BROADCAST if lines.count() <= MOST_BROADCAST else 0
        repeats = rows.groupBy("t1", "t2").agg(F.count("*").alias("n"))
        spread = F.coalesce("doc_id", F.lit(0))
        found = lookup_join(rows, gone, ["t1", "t2"], repeats, spread, how="left", most=most)
        keys = F.transform(lines_of(fold(F.col("text"))), lambda x: key_of(x, folded=True))
        return without_lines(
            found.select(
                "doc_id", "text", "g1", "g2",
                F.when(F.col("g1").isNotNull(), F.transform(keys, lambda x: F.xxhash64(x))).alias("a1"),
                F.when(F.col("g1").isNotNull(), F.transform(keys, lambda x: F.xxhash64(F.lit(1), x))).alias("a2"),
            )
        )


def text_names(text_col: str) -> list[Column]:
    """Two hashes that together name a text."""
    text = text_of(text_col)
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def probed(lines: DataFrame, filters, shards: int) -> DataFrame:
    """Rows ``(t1, t2, a1, a2)`` with those keys only that the filters may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: CuckooFilter(n, data) for k, (n, data) in filters.value.items()}
        for batch in batches:
            names = batch.column("a1").flatten().to_numpy().view(np.uint64)
            shard = (names.view(np.int64) % shards).astype(np.int64)
            may = np.zeros(len(names), bool)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for k, found in known.items():
                at = order[edges[k] : edges[k + 1]]
                may[at] = found.has(names[at])
            offsets = np.diff(np.asarray(batch.column("a1").offsets))
            row = np.repeat(np.arange(batch.num_rows), offsets)[may]
            hit = np.unique(row)
            cuts = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)[hit])), pa.int32())
            keep = pa.array(may)
            arrays = [
                pa.ListArray.from_arrays(cuts, batch.column(c).flatten().filter(keep))
                for c in ("a1", "a2")
            ]
            ids = [batch.column(c).take(pa.array(hit)) for c in ("t1", "t2")]
            yield pa.RecordBatch.from_arrays([*ids, *arrays], names=["t1", "t2", "a1", "a2"])

    return lines.mapInArrow(run, lines.schema)


def without_lines(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept, kept_sha256)`` of texts and the names of what goes."""
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept", T.StringType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept, digests = [], [], [], []
            columns = (batch.column(c) for c in ("text", "g1", "g2", "a1", "a2"))
            for text, *names in zip(*columns):
                lines = text.as_py().split("\n")
                n_lines.append(len(lines))
                if names[0].is_valid:
                    g1, g2, a1, a2 = (x.values.to_pylist() for x in names)
                    gone = set(zip(g1, g2))
                    lines = [x for x, name in zip(lines, zip(a1, a2)) if name not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append("\n".join(lines))
                digests.append(hashlib.sha256(kept[-1].encode()).hexdigest())
            arrays = [pa.array(n_lines), pa.array(n_dropped), pa.array(kept, pa.string()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)

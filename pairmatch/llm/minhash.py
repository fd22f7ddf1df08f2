"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.components import connected_components
from pairmatch.llm.text import LOWER, mix, utf8
from pairmatch.operators.joins import hot_keys, lookup_join, salted_join
from pairmatch.session import written

WIDTH = 5
#: Two sets are linked if PERCENT of the union lies in the intersection.
PERCENT = 85
#: Bands of ROWS signature values each. Sets at the threshold of 0.85 share no bucket with
#: probability (1 - 0.85 ** 5) ** 40, less than 1e-10; sets at 0.3 share one in ten.
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Centres per bucket in each round; the last number holds for all later rounds. Spark thins out
#: rows before they meet for limits up to 1000 only.
CENTRES = (1, 512)
#: Hashes of the centres of a bucket and round in all; the first centre counts whatever its size.
BLOCK_HASHES = 1 << 21
#: Members of a bucket that meet its centres in one task.
BLOCK_MEMBERS = 4096
#: Words hashed at once.
CHUNK_WORDS = 1 << 18
#: Word hashes that a worker remembers.
REMEMBERED = 1 << 18
#: Rows of a list of edges or ids, and hashes of a list of sets, up to which it is broadcast.
MOST_BROADCAST = 1_000_000
MOST_HASHES = 500_000


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def shingle_sets(texts: list[list[bytes]], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text.

    A text of fewer words is one shingle; one without words has none.
    """
    sizes = np.array([len(t) for t in texts])
    words = np.fromiter(
        (h for t in texts for h in map(_hashes.__getitem__, t)), np.uint64, int(sizes.sum())
    )
    ends = np.cumsum(sizes)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled = mix(rolled + words[k : k + len(rolled)])
    sets = []
    for start, stop in zip((ends - sizes).tolist(), ends.tolist()):
        if stop - start >= width:
            sets.append(np.unique(rolled[start : stop - width + 1]))
        elif stop > start:
            short = np.zeros(1, np.uint64) + np.uint64(stop - start)
            for word in words[start:stop]:
                short = mix(short + word)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


@lru_cache(maxsize=8192)
def probe(attempt: int, bins: int) -> np.ndarray:
    """The bin that each bin looks at in an attempt to borrow a value."""
    places = np.arange(bins, dtype=np.uint64) + np.uint64(attempt) * np.uint64(1 << 32)
    return (mix(places) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One-permutation signatures of non-empty sets, a row per set.

    Each hash falls into one bin by its upper bits, and a bin keeps its least hash. An empty
    bin borrows the value of a bin that a hash of its own place and the attempt names, trying on
    until it meets one that was not empty: every bin borrows independently, so two signatures
    agree in a bin with the probability of the sets' similarity.
    """
    sizes = np.array([len(s) for s in sets])
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = owner * bins + at
    first = np.concatenate(([True], cell[1:] != cell[:-1]))  # the sets are sorted
    values = np.zeros(len(sets) * bins, np.uint64)
    filled = np.zeros(len(sets) * bins, bool)
    values[cell[first]] = hashes[first]
    filled[cell[first]] = True
    open_, attempt = np.flatnonzero(~filled), 0
    while open_.size:
        attempt += 1
        source = open_ // bins * bins + probe(attempt, bins)[open_ % bins]
        found = filled[source]
        values[open_[found]] = values[source[found]]
        open_ = open_[~found]
    return values.reshape(len(sets), bins)


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit bucket key per band and signature."""
    parts = values.reshape(len(values), bands, -1)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(values), bands))
    for k in range(parts.shape[2]):
        keys = mix(keys + parts[:, :, k])
    return keys.view(np.int64)


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums per set that name it."""
    out = np.zeros((len(sets), 2), np.uint64)
    for k, hashes in enumerate(sets):
        for j in (0, 1):
            out[k, j] = mix(hashes + np.uint64(j + 1)).sum(dtype=np.uint64)
    return out.view(np.int64)


def chunks(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of a column's texts, some rows at a time."""
    waiting, held = [], 0
    for text in utf8(column):
        words = text.translate(LOWER).split()
        waiting.append(words)
        held += len(words)
        if held >= CHUNK_WORDS:
            yield waiting
            waiting, held = [], 0
    if waiting:
        yield waiting


def sketch(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, h1, h2, bands)`` of ``(doc_id, text)``; an empty set has no bands."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("h1", T.LongType()),
            T.StructField("h2", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):
                sets = shingle_sets(texts)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                keys = band_keys(signatures(full)) if full else np.zeros((0, BANDS), np.int64)
                names = set_names(sets)
                offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0))))
                bands = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(keys.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(sizes),
                        pa.array(names[:, 0]), pa.array(names[:, 1]), bands,
                    ],
                    names=schema.names,
                )
                at += len(texts)

    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the classes ``wanted`` (node, rep, h1, h2), from the texts."""
    same = F.col("doc_id").eqNullSafe(F.col("rep"))
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    side = F.broadcast(wanted) if few else wanted
    rows = docs.join(side, same).select("node", "h1", "h2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.stack([batch.column(k).to_numpy() for k in (1, 2)], axis=1)
            nodes, at = batch.column(0).to_numpy(), 0
            for texts in chunks(batch.column(3)):
                sets = shingle_sets(texts)
                part = slice(at, at + len(texts))
                at += len(texts)
                # a row of the same id with another text is none of this class
                own = np.flatnonzero((set_names(sets) == names[part]).all(axis=1))
                if own.size:
                    kept = [sets[k] for k in own]
                    offsets = np.concatenate(([0], np.cumsum([len(s) for s in kept])))
                    lists = pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.array(np.concatenate(kept).view(np.int64))
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[part][own]), lists], names=["node", "shingles"]
                    )

    sets = written(rows.mapInArrow(run, "node long, shingles array<long>"), "sets", "none")
    repeats = sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    if repeats.isEmpty():
        return sets
    # rows that repeat an id and its text
    return written(sets.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets", "none")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough; ``b`` is the star's centre.

    The set of ``a`` joins its edges where it is read if these are few. The centres' sets are
    sent there as well if they are small together; else they meet their edges in a salted join.
    """
    by_a = pairs.groupBy("a").agg(F.count("*").alias("n"))
    one = lookup_join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")),
        pairs, ["a"], by_a, F.col("a"), most=MOST_BROADCAST,
    )
    by_b = written(pairs.groupBy("b").agg(F.count("*").alias("n")), "centre-sizes")
    centres = lookup_join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")),
        by_b.select("b"), ["b"], by_b, F.col("b"), how="left_semi", most=MOST_BROADCAST,
    )
    hashes = centres.agg(F.coalesce(F.sum(F.size("sb")), F.lit(0))).first()[0]
    if hashes <= MOST_HASHES:
        both = one.join(F.broadcast(centres), "b")
    else:
        both = salted_join(one, centres, ["b"], hot_keys(by_b, ["b"]), F.col("a"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def bucket_members(classes: DataFrame) -> DataFrame:
    """``(key, node, n, score)`` of the buckets that hold two classes or more.

    ``score`` adds up the sizes of all buckets of a class: the class that others resemble most
    scores highest and makes the best centre.
    """
    rows = classes.select("node", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sizes = written(sizes, "bucket-sizes")
    counts = sizes.withColumnRenamed("size", "n")
    shared = lookup_join(rows, sizes, ["key"], counts, F.col("node"), most=MOST_BROADCAST)
    score = F.sum("size").over(Window.partitionBy("node"))
    return written(shared.withColumn("score", score).drop("size"), "buckets")


def one_each(keys: DataFrame) -> DataFrame:
    """Counts for a join in which no key is hot."""
    return keys.withColumn("n", F.lit(1))


def may_link(shared, sizes, percent: int = PERCENT):
    """Whether sets with ``sizes`` hashes in all can be linked by at most ``shared`` common ones."""
    return shared * (100 + percent) >= sizes * percent


def star_edges(
    members: DataFrame, centres: DataFrame, sizes: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """Distinct edges ``(a, b)`` from a bucket's members to its centre.

    ``sizes`` has the number ``n`` of members per bucket.
    """
    joined = lookup_join(
        members, centres, ["key"], sizes, F.col("node"), most=MOST_BROADCAST
    )
    apart = (F.col("node") != F.col("b")) & may_link(
        F.least("n", "n2"), F.col("n") + F.col("n2"), percent
    )
    return joined.where(apart).select(F.col("node").alias("a"), "b").distinct()


class Block:
    """The centres of a bucket, which its members are compared with one after the other."""

    def __init__(self):
        self.nodes, self.comps, self.sets = [], [], []
        self.parent: dict[int, int] = {}
        self.hashes = None

    def add(self, node: int, comp: int, hashes: np.ndarray) -> None:
        self.nodes.append(node)
        self.comps.append(comp)
        self.sets.append(hashes)

    def root(self, comp: int) -> int:
        while (up := self.parent.get(comp, comp)) != comp:
            self.parent[comp] = self.parent.get(up, up)
            comp = up
        return comp

    def links(self, node: int, comp: int, hashes: np.ndarray, percent: int) -> list[int]:
        """Centres that the member is similar enough to, as far as they join components anew."""
        if self.hashes is None:
            self.sizes = np.array([len(s) for s in self.sets], np.int64)
            self.hashes = np.concatenate(self.sets) if self.sets else np.zeros(0, np.int64)
            order = np.argsort(self.hashes, kind="stable")
            self.owner = np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            self.hashes = self.hashes[order]
            self.sets = None
        low = np.searchsorted(self.hashes, hashes, side="left")
        n = np.searchsorted(self.hashes, hashes, side="right") - low
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - n, n) + np.repeat(low, n)
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        union = len(hashes) + self.sizes - common
        out = []
        for k in np.flatnonzero(common * 100 >= union * percent).tolist():
            one, other = self.root(comp), self.root(self.comps[k])
            if one != other:
                self.parent[one] = other
                out.append(self.nodes[k])
        return out


def block_links(
    members: DataFrame, centres: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """Links ``(a, b)`` from the members of buckets to their centres, without a row per pair.

    ``members`` has ``(key, node, comp)``, ``centres`` those of them that are centres, ``sizes``
    the number ``n`` of members per bucket. A bucket's members are dealt into parts of some
    ``BLOCK_MEMBERS``; each part gets its centres once, so there are rows for members and, of a
    part, centres. A part is sorted with its centres first, and its members stream past them.
    All pairs of a member and a centre are compared on full sets; of those similar enough the
    ones that join two components are returned, fewer than there are members and centres.
    """
    parts = sizes.select(
        "key", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("parts"), "n"
    )
    small = parts.select("key", "parts")
    dealt = lookup_join(
        members.select("key", "node", "comp"), small, ["key"], sizes, F.col("node"), most=MOST_BROADCAST
    ).select(
        "key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
        F.lit(1).alias("kind"), "node", "comp",
    )
    repeated = lookup_join(
        centres.select("key", "node", "comp"), small, ["key"], sizes, F.col("node"), most=MOST_BROADCAST
    ).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("kind"), "node", "comp",
    )
    rows = written(dealt.unionByName(repeated), "block-rows")
    known = rows.groupBy("node").agg(F.count("*").alias("n"))
    with_sets = salted_join(
        rows, sets, ["node"], hot_keys(known, ["node"]), F.struct("key", "part")
    ).select("key", "part", "kind", "node", "comp", "shingles")
    sorted_rows = with_sets.repartition("key", "part").sortWithinPartitions("key", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, Block()
        for batch in batches:
            key, part, kind, node, comp = (batch.column(k).to_pylist() for k in range(5))
            lists = batch.column(5)
            offsets = lists.offsets.to_numpy().tolist()
            values = lists.values.to_numpy()
            a, b = [], []
            for k in range(len(key)):
                if (key[k], part[k]) != current:
                    current, block = (key[k], part[k]), Block()
                hashes = values[offsets[k] : offsets[k + 1]]
                if kind[k] == 0:
                    block.add(node[k], comp[k], hashes.copy())
                else:
                    found = block.links(node[k], comp[k], hashes, percent)
                    a.extend([node[k]] * len(found))
                    b.extend(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    return sorted_rows.mapInArrow(run, "a long, b long")


def with_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the component of every member and its number of classes."""
    counts = labels.groupBy("comp").agg(F.count("*").alias("comp_size"))
    known = written(labels.join(counts, "comp"), "component-sizes")
    joined = lookup_join(
        members, known, ["node"], one_each(known), F.col("key"), "left", MOST_BROADCAST
    )
    return written(
        joined.withColumns(
            {
                "comp": F.coalesce("comp", "node"),
                "comp_size": F.coalesce("comp_size", F.lit(1)),
            }
        ),
        "placed",
    )


def open_buckets(placed: DataFrame) -> DataFrame:
    """``(key, n, least)`` of the buckets with classes still to compare: members that were no
    centre yet, of two components or more. ``least`` is the size of the smallest set."""
    waiting = F.when(~F.col("central"), F.col("comp"))
    state = placed.groupBy("key").agg(
        F.min(waiting).alias("low"), F.max(waiting).alias("high"), F.count("*").alias("n"),
        F.min("n").alias("least"),
    )
    return written(state.where("low < high").select("key", "n", "least"), "open")


def in_buckets(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """The members of these buckets, with the size of the smallest set there."""
    return lookup_join(
        placed, sizes.select("key", "least"), ["key"], sizes, F.col("node"), most=MOST_BROADCAST
    )


def still_possible(
    placed: DataFrame, sets: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """Members of open buckets that may have a partner at all.

    Hashes that only one of the sets at hand has are in no intersection. What is left of a
    set, ``shared``, bounds its intersections, and a member is dropped where even the smallest
    set of its bucket is too large for that. In a group of copies with many edits each, this
    leaves few members.
    """
    nodes = written(placed.select("node").distinct(), "open-nodes")
    own = lookup_join(
        sets, nodes, ["node"], one_each(nodes), F.col("node"), "left_semi", MOST_BROADCAST
    )
    once = (
        own.select("node", F.explode("shingles").alias("h"))
        .groupBy("h")
        .agg(F.count("*").alias("n"), F.min("node").alias("node"))
        .where("n = 1")
    )
    alone = written(once.groupBy("node").agg(F.count("*").alias("alone")), "alone")
    joined = lookup_join(
        placed, alone, ["node"], one_each(alone), F.col("key"), "left", MOST_BROADCAST
    )
    shared = F.col("n") - F.coalesce("alone", F.lit(0))
    kept = joined.withColumn("shared", shared).where(
        may_link(F.col("shared"), F.col("n") + F.col("least"), percent)
    )
    return written(kept.drop("alone", "shared"), "possible")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Components of texts linked by similar sets of word shingles.

    Two sets are linked if ``percent`` of their union or more lies in the intersection. The bands
    miss a pair at 85 with a probability below 1e-10 and one at 80 with about 1e-7; lower
    thresholds need more bands.

    Texts of equal sets are one class first. The classes' signatures are cut into bands, and
    classes that agree in a band share a bucket. A bucket gives star-shaped edges: every member
    to one centre, so the number of pairs is linear in the number of members. Edges are
    confirmed on full sets, confirmed ones make components. A star alone would lose links
    between members, so further rounds follow: buckets that still hold several components get
    more centres, those of small components first, which all members are compared with inside
    tasks (``block_links``), until the members left are of one component. So every pair that
    shares a bucket is in one component, has been compared, or cannot be similar enough for want
    of hashes that another set has. No round makes a row per pair; the number of comparisons
    inside tasks is quadratic only in members of a bucket that stay in different components.

    Returns a row per row: ``(doc_id, n_shingles, component_id, kept, h1, h2)``, the last two
    naming the set. Hot classes, buckets and centres are salted.

    Null and empty texts have no shingles and are linked with nothing. Rows of one id and text
    get the same result each. Null ids come after all others: a component's id is null only if
    no row in it has one, and only then rows without id are kept. An empty table gives an empty
    result; other columns are not looked at.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(sketch(source), "sketch")
    name = ["h1", "h2", "n"]
    classes = written(
        rows.where("n > 0")
        .groupBy(*name)
        .agg(
            F.min("doc_id").alias("rep"),
            F.any_value("bands").alias("bands"),
            F.count("*").alias("times"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    members = bucket_members(classes)
    nodes = members.select("node").distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("node", "rep", "h1", "h2")
    sets = full_sets(source, written(wanted, "wanted"))

    links = None
    labels = classes.select("node", F.col("node").alias("comp")).where("false")
    members = members.withColumn("central", F.lit(False))
    for number, per_bucket in enumerate(chain(CENTRES, repeat(CENTRES[-1]))):
        placed = with_components(members, labels)
        sizes = open_buckets(placed)
        if sizes.isEmpty():
            break
        placed = in_buckets(placed, sizes)
        if number == 1:
            placed = still_possible(placed, sets, percent)
            sizes = open_buckets(placed)
            if sizes.isEmpty():
                break
            placed = in_buckets(placed.drop("least"), sizes)
        # members of the largest component need not become centres: the others meet them
        order = Window.partitionBy("key").orderBy("comp_size", F.desc("score"), "node")
        before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        chosen = written(
            placed.where(~F.col("central"))
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= per_bucket)
            .withColumn("hashes", F.sum("n").over(before))
            .where((F.col("hashes") <= BLOCK_HASHES) | (F.col("rank") == 1))
            .select("key", "node", "n", "comp"),
            "centres",
        )
        mark = chosen.select("key", "node", F.lit(True).alias("chosen"))
        marked = lookup_join(
            placed, mark, ["key", "node"], one_each(mark), F.col("node"), "left", MOST_BROADCAST
        )
        marked = written(marked.fillna(False, ["chosen"]), "members")
        if number == 0:
            centres = chosen.select("key", F.col("node").alias("b"), F.col("n").alias("n2"))
            found = linked(written(star_edges(marked, centres, sizes, percent), "edges"), sets, percent)
        else:
            # earlier centres have been compared with all members
            waiting = marked.where(~F.col("central"))
            found = block_links(waiting, chosen, sizes, sets, percent)
        found = written(found, "links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = connected_components(links)
        members = marked.withColumn("central", F.col("central") | F.col("chosen")).select(
            "key", "node", "n", "score", "central"
        )
    reps = labels.join(classes.select("node", "rep"), "node")
    first = written(reps.groupBy("comp").agg(F.min("rep").alias("first")), "first")
    named = lookup_join(
        labels, first, ["comp"], labels.groupBy("comp").agg(F.count("*").alias("n")),
        F.col("node"), most=MOST_BROADCAST,
    )
    components = written(
        classes.join(named.select("node", "first"), "node", "left").select(
            *name, F.coalesce("first", "rep").alias("component_id"), F.col("times").alias("n_rows")
        ),
        "named-classes",
    )
    placed = lookup_join(
        rows.where("n > 0"), components.drop("n_rows"), name,
        components, F.col("doc_id"), "left", MOST_BROADCAST, "n_rows",
    )
    alone = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n", "h1", "h2", "component_id"]
    return (
        placed.select(*columns)
        .unionByName(alone.select(*columns))
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
            "h1",
            "h2",
        )
    )

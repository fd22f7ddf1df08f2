"""Benchmark passages in training texts, found by an FM-index per training shard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.fm_index import FMIndex
from pairmatch.llm.text import LOWER, LOWER_ALNUM, utf8

WINDOW = 13
#: Words in one index; a shard is a part of the rows of one task.
SHARD_WORDS = 1 << 20
#: Words of the benchmark that are sent to the tasks at once; a larger one comes in blocks.
BLOCK_WORDS = 1 << 22
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SPANS = "array<struct<start:int,stop:int>>"


class Phrases:
    """The windows of a block of benchmark items, as numbers of the words they use."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            words = text.translate(LOWER_ALNUM).split()
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[at : at + window]), set()).add(name)
        self.shortest = min(map(len, windows), default=0)
        self.by_length = []
        for length in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == length]
            names = [sorted(windows[w]) for w in own]
            self.by_length.append((length, np.array(own, np.int64).reshape(-1, length), names))


def runs(numbers: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Stretches of known words that a window may lie in."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (numbers > 0).view(np.int8), [0]))))
    starts, stops = edges[::2], edges[1::2]
    keep = stops - starts >= shortest
    return list(zip(starts[keep].tolist(), stops[keep].tolist()))


def search_shard(phrases: Phrases, texts: list[np.ndarray]):
    """Hit words and item names of each text of a shard: ``[(mask or None, names)]``.

    Words that no phrase uses cannot be in a window, so the index is built over the stretches
    between them that are long enough.
    """
    pieces, owners, offsets, starts, size = [], [], [], [], 0
    for owner, numbers in enumerate(texts):
        for start, stop in runs(numbers, phrases.shortest):
            pieces += [numbers[start:stop], np.zeros(1, np.int64)]
            owners.append(owner)
            offsets.append(start)
            starts.append(size)
            size += stop - start + 1
    found: list[tuple[np.ndarray | None, set[str]]] = [(None, set()) for _ in texts]
    if not pieces:
        return found
    index = FMIndex(np.concatenate(pieces), len(phrases.numbers))
    starts_at, owner_of, offset_of = map(np.array, (starts, owners, offsets))
    for length, patterns, names in phrases.by_length:
        low, high = index.search(patterns)
        times = high - low
        which = np.repeat(np.arange(len(patterns)), times)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
        at = index.locate(rows)
        run = np.searchsorted(starts_at, at, side="right") - 1
        owner, word = owner_of[run], offset_of[run] + at - starts_at[run]
        by = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[by], prepend=-1))
        for group in np.split(by, cuts[1:]) if len(by) else []:
            text = int(owner[group[0]])
            edges = np.zeros(len(texts[text]) + 1, np.int64)
            np.add.at(edges, word[group], 1)
            np.add.at(edges, word[group] + length, -1)
            mask = np.cumsum(edges[:-1]) > 0
            old, items = found[text]
            for pattern in np.unique(which[group]):
                items.update(names[pattern])
            found[text] = (mask if old is None else old | mask, items)
    return found


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Merged stretches of hit words, as (first, one after the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as UTF-8 offsets in the text."""
    if not spans:
        return []
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def _search(docs: DataFrame, items: list[tuple[str, bytes]], window: int, shard: int) -> DataFrame:
    """One pass over ``(doc_id, text)`` with a block of items."""
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))
    spans = T.DataType.fromDDL(SPANS)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("words", spans),
            T.StructField("spans", spans),
        ]
    )
    pair = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases.value
        for batch in batches:
            column, waiting, held = batch.column(1), [], 0
            sizes, hits, names, words, places = [], [], [], [], []

            def flush() -> None:
                first = len(sizes)
                for k, (mask, items) in enumerate(search_shard(known, waiting)):
                    merged = [] if mask is None else spans_of(mask)
                    text = (column[first + k].as_py() or "").encode() if merged else b""
                    sizes.append(len(waiting[k]))
                    hits.append(sum(b - a for a, b in merged))
                    names.append(sorted(items))
                    words.append([{"start": a, "stop": b} for a, b in merged])
                    cut = byte_spans(text, merged)
                    places.append([{"start": a, "stop": b} for a, b in cut])

            for text in utf8(column):
                tokens = text.translate(LOWER_ALNUM).split()
                lookup = known.numbers.get
                waiting.append(np.fromiter((lookup(t, 0) for t in tokens), np.int64, len(tokens)))
                held += len(tokens)
                if held >= shard:
                    flush()
                    waiting, held = [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()),
                    pa.array(names, pa.list_(pa.string())), pa.array(words, pair),
                    pa.array(places, pair),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Words of every text that lie in a window of a benchmark item.

    A window is ``window`` consecutive words of an item, or the whole of a shorter one. Returns
    a row per row of ``docs``: ``(doc_id, n_words, n_hit, items, words, spans)``: hit words,
    distinct item names as strings in order, and the merged stretches as word numbers and as
    UTF-8 offsets, for removal.

    Every task cuts its rows into shards of about ``shard_words`` words (texts stay whole),
    builds an FM-index over each, searches all windows backwards at once and locates them by
    sampled positions. Texts are not shuffled. The benchmark is sent to the tasks; one of more
    than ``block_words`` words is searched block by block and the hits are merged per document
    (UTF-8 stretches that only touch then stay apart).

    Null and empty texts have no words; null items no windows. A null item name is an empty one,
    items of the same name count once. Rows with equal or null ids are judged each by its own
    text. Other columns are not looked at; an empty benchmark hits nothing.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"),
        F.col(item_text_col).cast("binary").alias("text"),
    ).where(F.col("text").isNotNull())
    # a word has a byte and a separator at least
    words = items.agg(F.coalesce(F.sum((F.octet_length("text") + 1) / 2), F.lit(0))).first()[0]
    blocks = max(1, -(-int(words) // block_words))

    def block(number: int) -> list[tuple[str, bytes]]:
        own = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == number)
        return [(r["name"], bytes(r["text"])) for r in own.collect()]

    if blocks == 1:
        return _search(texts, block(0), window, shard_words)
    keyed = texts.select(
        F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).alias("doc_id"),
        "text",
    )
    parts = _search(keyed, block(0), window, shard_words)
    for number in range(1, blocks):
        parts = parts.unionByName(_search(keyed, block(number), window, shard_words))

    def joined(column: str):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))

    merged = parts.groupBy("doc_id", "n_words").agg(
        joined("items").alias("items"), merge(joined("words")).alias("words"),
        merge(joined("spans")).alias("spans"), (F.count("*") / blocks).cast("int").alias("times"),
    )
    hit = F.aggregate("words", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(
        F.col("doc_id.doc_id").alias("doc_id"), "n_words", hit.cast("long").alias("n_hit"),
        "items", "words", "spans",
    )


def merge(spans):
    """Stretches in order of their start, those that touch or overlap as one."""
    empty = F.array().cast(SPANS)

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop")
        )
        touches = (F.size(done) > 0) & (last["stop"] >= span["start"])
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(shorter, F.array(longer))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(spans, empty, add)

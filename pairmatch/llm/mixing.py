"""Mix sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.llm.text import before, text_of, word_count
from pairmatch.operators.joins import lookup_join
from pairmatch.session import written

#: A document is repeated at most this often.
EPOCHS = 3
#: Sources up to which their table is broadcast.
MOST_SOURCES = 100_000
#: Pieces of the seeded order of a source (its 60 bits without the lower 48); only the piece
#: with the border is sorted.
PIECES = 4096


def cyclic_weight(place: Column) -> Column:
    """Weights 1, 2, 3, 1, ... by the place 0, 1, ... of a source."""
    return (place % 3 + 1).cast("long")


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Targets of sources ``(source_size, weight)`` that share the sum of all sizes by weight.

    A source is clamped at ``epochs`` times its size and the excess goes to the others by
    weight, until none is above. Sorted by size over weight the clamped sources come first:
    each is tested with the level that holds when all before it are clamped. The table has a
    row per source, so one window over it is small.
    """
    order = [F.col("source_size") / F.col("weight"), F.col("weight"), F.col("key")]
    earlier = before([], *order)
    everything = Window.partitionBy()
    cap = F.col("source_size") * epochs
    cap_before = F.coalesce(F.sum(cap).over(earlier), F.lit(0))
    weight_before = F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    tested = sources.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "weights": F.sum("weight").over(everything),
            "cap": cap,
            "cap_before": cap_before,
            "weight_before": weight_before,
        }
    ).withColumn(
        "clamped",
        F.col("cap") * (F.col("weights") - F.col("weight_before"))
        < (F.col("total") - F.col("cap_before")) * F.col("weight"),
    )

    def clamped(column: str) -> Column:
        return F.sum(F.when(F.col("clamped"), F.col(column)).otherwise(F.lit(0))).over(everything)

    free = tested.withColumns(
        {"free": F.col("total") - clamped("cap"), "by": F.col("weights") - clamped("weight")}
    )
    share = (F.col("weight") * F.col("free")).cast("double") / F.col("by")
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share)
    return free.withColumn("target", target).select(*sources.columns, "target")


def mixed(
    docs: DataFrame,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    epochs: int = EPOCHS,
    weight=cyclic_weight,
    most: int = MOST_SOURCES,
) -> DataFrame:
    """How often the mix takes each row: ``(doc, size, source_size, target, reps)``.

    ``doc`` is a struct of the ``carry`` columns (all columns if none are named), so their names
    never clash. Sources are numbered by code point, null last, and weighed by ``weight`` of
    that number. The targets come from ``water_fill``. With e = target / size, every row of a
    source is taken floor(e) times, and a seeded sample of rows with words once more: the first
    rows in the order of a digest of seed and id whose words make up the rest, the row at the
    border if that comes closer. So a source misses its target by half a row at most, no row is
    taken more than ``epochs`` times, and reruns agree.

    That order is cut into pieces: sums per piece tell which lie before the border, and only the
    rows of the border piece are sorted. The table of sources is broadcast up to ``most`` rows and
    joined with salts otherwise, so a source with a large part of all rows is no single task.

    Null text: no words; such a row is taken floor(e) times. Null id: the digest is that of the text. Rows that agree in digest and
    size are interchangeable. An empty table gives an empty result; a mix of no words takes
    nothing.
    """
    text, name = text_of(text_col), F.col(id_col).cast("string")
    source = F.col(source_col).cast("string")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name, text)))
    place = F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")
    sized = written(
        docs.select(
            F.struct(*(F.col(c) for c in carry or docs.columns)).alias("doc"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("key"),
            word_count(text).alias("size"),
            place.alias("place"),
        ).withColumn("piece", F.shiftright("place", 48).cast("int")),
        "sized",
    )
    pieces = written(
        sized.groupBy("key", "source", "piece").agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        ),
        "pieces",
    )
    sources = pieces.groupBy("key", "source").agg(
        F.sum("words").alias("source_size"), F.sum("n").alias("n")
    )
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    targets = water_fill(sources.withColumn("weight", weight(number)), epochs).withColumn(
        "whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    ).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = written(targets, "targets")
    running = pieces.withColumn(
        "before", F.coalesce(F.sum("words").over(before(["key"], "piece")), F.lit(0))
    ).join(targets.select("key", "quota"), "key")
    over = F.col("before") + F.col("words") > F.col("quota")
    border = running.where(over).groupBy("key").agg(F.min(F.struct("piece", "before")).alias("at"))
    plan = targets.join(border, "key", "left").select(
        "key",
        "source_size",
        "target",
        "whole",
        F.coalesce("at.piece", F.lit(PIECES)).alias("at"),
        (F.col("quota") - F.col("at.before")).alias("rest"),
    )
    joined = lookup_join(sized, plan, ["key"], sources, F.col("place"), most=most)
    # the border piece of a source holds about 1 / 4096 of its rows
    at_border = F.col("piece") == F.col("at")
    so_far = F.coalesce(F.sum("size").over(before(["key"], "place", "size")), F.lit(0))
    extra = (so_far + F.col("size") / 2 <= F.col("rest")).cast("long")
    words = (F.col("size") > 0).cast("long")
    result = ["doc", "size", "source_size", "target"]
    return (
        joined.where(at_border)
        .withColumn("extra", extra)
        .unionByName(
            joined.where(~at_border).withColumn(
                "extra", (F.col("piece") < F.col("at")).cast("long")
            )
        )
        .select(*result, (F.col("whole") + F.col("extra") * words).alias("reps"))
    )

"""Elements of large JSON lists, read by many tasks whatever the file's lay-out.

A text file is read in parts that end at a comma, so one line of many gigabytes is split like any
other file. What a comma means depends on all parts before it: whether it stands in a string,
and how deep it is nested. Both follow from running sums: of quotes, whose parity tells
strings from structure, then of opening minus closing brackets. Sums run within a block of the
file; the blocks' totals, one row each, are added up before them and joined back. A block's
totals are kept for both parities it may start with, so one pass gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from usagelens.functions.times import utc_ntz

_STRING = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\z)'
_TO_THE_QUOTE = r'(?s)\A(?:[^"\\]++|\\.)*+(?:"|\z)'
_BLOCK = ["_file", "_block"]


def raw_parts(texts: DataFrame) -> DataFrame:
    """``file, block, collected_at, text`` of what a text reader with commas as line ends gives;
    also of a stream."""
    return texts.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        utc_ntz(F.col("_metadata.file_modification_time")).alias("collected_at"),
        F.col("value").alias("text"),
    )


def _placed(raw: DataFrame) -> DataFrame:
    """The parts with their place; within a block the ids rise from part to part."""
    return raw.select(
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
        "collected_at",
        "text",
    )


def _in_block() -> WindowSpec:
    return Window.partitionBy(*_BLOCK).orderBy("_place")


def _parts_before(column: str) -> Column:
    """The sum over the parts before this one in its block."""
    rows = _in_block().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(rows), F.lit(0))


def _blocks_before(column: str) -> Column:
    """The sum over the blocks before this one in its file; there is one row per block."""
    rows = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(rows), F.lit(0))


def _whole_file(value: Column) -> Column:
    return value.over(Window.partitionBy("_file"))


def _count(text: Column, character: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(character), F.lit("")))


def _joined_by_block(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    renamed = blocks.withColumnsRenamed({c: f"{c}_" for c in _BLOCK})
    same = (F.col("_file") == F.col("_file_")) & (F.col("_block") == F.col("_block_"))
    return parts.join(renamed, same).drop("_file_", "_block_")


def with_depth(parts: DataFrame) -> DataFrame:
    """Adds where each part starts: ``first`` of its file or not, ``inside`` a string or not, with
    how many ``braces`` and ``brackets`` open; and of the file: ``listed`` (it is a list),
    ``cut`` (something is still open at its end) and ``between`` (only the list itself is)."""
    step = parts.withColumns(
        {
            "quotes": _count(F.regexp_replace("text", r"(?s)\\.", ""), '"'),
            # without strings, if the part starts outside or inside one
            "bare0": F.regexp_replace("text", _STRING, ""),
            "bare1": F.regexp_replace(F.regexp_replace("text", _TO_THE_QUOTE, ""), _STRING, ""),
            "first": (F.col("_block") == 0) & (F.row_number().over(_in_block()) == 1),
        }
    )
    step = step.withColumns(
        {
            f"{name}{side}": _count(F.col(f"bare{side}"), pair[0]) - _count(F.col(f"bare{side}"), pair[1])
            for name, pair in (("braces", "{}"), ("brackets", "[]"))
            for side in (0, 1)
        }
    ).drop("bare0", "bare1")
    step = step.withColumn("turned", _parts_before("quotes") % 2 == 1)

    def total(name: str, side: int) -> Column:
        """Of a block that starts outside (0) or inside (1) a string."""
        return F.sum(F.when(F.col("turned"), F.col(f"{name}{1 - side}")).otherwise(F.col(f"{name}{side}")))

    totals = step.groupBy(*_BLOCK).agg(
        F.sum("quotes").alias("quotes"),
        F.max(F.col("first") & F.col("text").rlike(r"\A\s*\[")).alias("listed"),
        *[total(name, side).alias(f"{name}{side}") for name in ("braces", "brackets") for side in (0, 1)],
    )
    totals = totals.withColumn("odd", _blocks_before("quotes") % 2 == 1)
    names = ("braces", "brackets")
    own = {n: F.when(F.col("odd"), F.col(f"{n}1")).otherwise(F.col(f"{n}0")) for n in names}
    totals = totals.withColumns(own)
    outside = (_whole_file(F.sum("braces")) == 0) & (_whole_file(F.sum("quotes")) % 2 == 0)
    brackets = _whole_file(F.sum("brackets"))
    starts = totals.select(
        *_BLOCK,
        "odd",
        *[_blocks_before(n).alias(f"{n}_before") for n in names],
        _whole_file(F.max("listed")).alias("listed"),
        (~outside | (brackets != 0)).alias("cut"),
        (outside & (brackets == 1)).alias("between"),
    )
    step = _joined_by_block(step, starts).withColumn("inside", F.col("odd") != F.col("turned"))
    step = step.withColumns({n: F.when(F.col("inside"), F.col(f"{n}1")).otherwise(F.col(f"{n}0")) for n in names})
    return step.select(
        *parts.columns,
        "first",
        "inside",
        *[(F.col(f"{n}_before") + _parts_before(n)).alias(n) for n in names],
        "listed",
        "cut",
        "between",
    )


def list_items(spark: SparkSession, path: str) -> DataFrame:
    """The elements of all list files of a folder, as ``items_of``."""
    return items_of(raw_parts(spark.read.option("lineSep", ",").text(path)))


def items_of(raw: DataFrame) -> DataFrame:
    """``value`` (an element's text), ``pos`` in its file's list, ``file``, ``collected_at``,
    ``broken``, and whether the file is ``listed``, that is, a list.

    An element is what stands between two commas of the list itself; its parts come together in
    one shuffle. A file that is no list is one element. A file that is cut somewhere, or has
    something behind its list, has one row more that is ``broken``: what there is of the
    unfinished element, or nothing if the last one is a whole object, list or string (a number
    may go on, so it is unfinished). An empty list and an empty file have no rows.
    """
    parts = with_depth(_placed(raw))
    border = ~F.col("first") & ~F.col("inside") & F.col("listed") & (F.col("braces") == 0) & (F.col("brackets") == 1)
    marked = parts.withColumn("starts", border.cast("int"))
    counts = marked.groupBy(*_BLOCK).agg(F.sum("starts").alias("n"))
    counts = counts.select(*_BLOCK, _blocks_before("n").alias("before"), _whole_file(F.sum("n")).alias("last"))
    numbered = _joined_by_block(marked, counts)
    number = F.col("before") + _parts_before("starts") + F.col("starts")
    # the comma before a part belongs to the element, if it is no border
    glue = F.when(F.col("first") | (F.col("starts") == 1), "").otherwise(",")
    pieces = numbered.select("*", number.alias("pos"), F.struct("_block", "_place", F.concat(glue, "text").alias("t")).alias("piece"))
    ordered = F.array_sort(F.collect_list("piece"))
    items = pieces.groupBy("_file", "pos").agg(
        F.array_join(F.transform(ordered, lambda p: p["t"]), "").alias("value"),
        *[F.first(c).alias(c) for c in ("collected_at", "listed", "cut", "between", "last")],
    )
    is_last = F.col("pos") == F.col("last")
    closed = F.col("value").rlike(r"\]\s*\z")
    broken = F.col("listed") & is_last & (F.col("cut") | ~closed)
    opened = F.when(F.col("listed") & (F.col("pos") == 0), F.regexp_replace("value", r"\A\s*\[", "")).otherwise(F.col("value"))
    items = items.select("*", broken.alias("broken"), opened.alias("opened"))
    whole = F.col("listed") & is_last & ~F.col("broken")
    text = F.when(whole, F.regexp_replace("opened", r"\]\s*\z", "")).otherwise(F.col("opened"))
    bare = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    items = items.select("*", bare.alias("bare"))
    nothing = (F.col("bare") == "") & (F.col("pos") == 0) & (F.col("last") == 0) & ~F.col("broken")
    finished = F.col("broken") & F.col("between") & F.col("bare").rlike(r'[}\]"]\z')

    def row(value: Column, pos: Column, broken: Column) -> Column:
        return F.struct(value.alias("value"), pos.alias("pos"), broken.alias("broken"))

    tail = row(F.lit(""), F.col("pos") + 1, F.lit(True))
    rows = F.when(finished, F.array(row(F.col("bare"), F.col("pos"), F.lit(False)), tail)).otherwise(
        F.array(row(F.col("bare"), F.col("pos"), F.col("broken")))
    )
    items = items.where(~nothing).select(F.col("_file").alias("file"), "collected_at", "listed", F.inline(rows))
    return items.select("value", "pos", "file", "collected_at", "broken", "listed")

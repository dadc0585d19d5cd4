"""Landed stats documents -> typed documents and a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.documents import usage_of_texts, whole_measures
from usagelens.functions.times import utc_ntz
from usagelens.schemas import CORRUPT, RAW
from usagelens.sources.borders import list_items

_BAD = T.StructField(CORRUPT, T.StringType(), True)
_STRICT = T.StructType([*RAW.fields, _BAD])
# The same with the usage values as text.
_TEXTS = T.StructField("usage", T.MapType(T.StringType(), T.StringType()))
_LOOSE = T.StructType([_TEXTS if f.name == "usage" else f for f in _STRICT.fields])
_PARSE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

# End of a top-level element in an array document indented by four spaces. Nested
# objects are indented deeper, and JSON strings hold no raw line breaks.
PRETTY_RECORD_END = "\n    },"


# Columns that tell in which order documents arrived: the offset of the file block a line
# was read from, and the position in the list a document was taken from.
BLOCK = "block"
ARRIVAL = "arrival"
# Tells the rest of a cut file, which is no document whatever it looks like.
BROKEN = "broken"


def _landed() -> list[Column]:
    """When the file landed; the same on every retry, so a replayed batch is unchanged."""
    return [
        utc_ntz(F.col("_metadata.file_modification_time")).alias("collected_at"),
        F.col("_metadata.file_block_start").alias(BLOCK),
    ]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line (splittable). Columns ``value, collected_at, block``."""
    return spark.read.text(path).select("value", *_landed()).filter(F.trim("value") != "")


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same, as a stream over the files that land in ``path``."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select("value", *_landed()).filter(F.trim("value") != "")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays (or one object) per file, however they are laid out: one huge line is read by
    many tasks. A cut file keeps its whole documents and has one ``broken`` row.
    """
    return array_documents(list_items(spark, path))


def array_documents(items: DataFrame) -> DataFrame:
    """List elements as documents: ``value, collected_at, arrival, broken``."""
    return items.select("value", "collected_at", F.col("pos").cast("int").alias(ARRIVAL), BROKEN)


def split_arrays(df: DataFrame) -> DataFrame:
    """Explode ``value`` (array text or a single document) into one document per row, with
    its position in the list as ``arrival``. A list that cannot be read is one ``broken`` row.
    """
    is_list = F.col("value").rlike(r"\A\s*\[")
    items = F.when(is_list, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rest = [c for c in df.columns if c != "value"]
    marked = df.select(*rest, F.col("value").alias("_text"), items.alias("_items"))
    broken = F.col("_items").isNull()
    items = F.coalesce("_items", F.array("_text"))
    return marked.select(*rest, broken.alias(BROKEN), F.posexplode(items).alias(ARRIVAL, "value"))


def read_pretty_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Array files indented by four spaces, the admin tool's native print.

    The record end serves as line separator, so one huge file is read by many tasks.
    """
    lines = spark.read.option("lineSep", PRETTY_RECORD_END).text(path)
    # only the first record carries the opening bracket, only the last the closing one,
    # which stands at the start of a line; the others lost their brace to the separator
    last = F.col("value").rlike(r"\n\]\s*$")
    opened = F.regexp_replace("value", r"^\s*\[?\s*", "")
    text = F.regexp_replace(opened, r"\s*(\n\])?\s*$", "")
    document = F.when(last, text).otherwise(F.concat(text, F.lit("\n    }")))
    return (
        lines.select(document.alias("value"), text.alias("text"), *_landed())
        .filter(~F.col("text").isin("", "]"))
        .drop("text")
    )


def parse_documents(df: DataFrame, value: str = "value") -> DataFrame:
    """The columns of ``df``, the document keys, and ``_bad``: the text of a document that
    does not fit the schema. No column of ``df`` may be named like a document key.

    The parsed struct goes through a generator. Without it a later filter would be pushed
    below the projection and parse every document again.

    A row marked ``broken`` is bad; the mark goes.

    Usage values that are no objects are skipped, but one of them voids the whole map of a
    typed parse. Only documents that fail are therefore read a second time, with the usage
    values as text.
    """
    text = F.col(value)
    parsed = df.select("*", F.inline(F.array(F.from_json(text, _STRICT, _PARSE_OPTIONS))))
    failed = F.col(CORRUPT).isNotNull()
    loose = F.when(failed, F.from_json(text, _LOOSE, _PARSE_OPTIONS))
    second = parsed.withColumn("_loose", loose)
    # still bad: something else than the usage, or a measure that is no number
    texts = F.when(F.col(f"_loose.{CORRUPT}").isNull(), F.col("_loose.usage"))
    second = second.withColumn("_second", F.when(failed, usage_of_texts(texts)))
    odd = F.exists(F.map_values("_second"), lambda cls: cls[CORRUPT].isNotNull())
    rescued = failed & F.col("_second").isNotNull() & ~odd
    objects = F.map_filter("usage", lambda _, cls: cls.isNotNull())
    bad = F.when(~rescued, F.col(CORRUPT))
    if BROKEN in df.columns:
        bad = F.when(F.col(BROKEN), F.coalesce(text, F.lit(""))).otherwise(bad)
    return second.withColumns(
        {
            "usage": F.when(rescued, whole_measures(F.col("_second"))).otherwise(objects),
            CORRUPT: bad,
        }
    ).drop("_loose", "_second", BROKEN)


def readable() -> Column:
    return F.col(CORRUPT).isNull()


def named() -> Column:
    return F.coalesce(F.col("bucket"), F.lit("")) != ""


def good_documents(parsed: DataFrame) -> DataFrame:
    """Documents that fit the schema and name an entity."""
    return parsed.filter(readable() & named()).drop("value", CORRUPT, BLOCK)


def quarantine(parsed: DataFrame) -> DataFrame:
    """The rest, as text with a reason."""
    reason = F.when(~readable(), "unreadable").otherwise("no entity name")
    rest = parsed.filter(~readable() | ~named())
    return rest.select("value", "collected_at", reason.alias("reason"))


def one_entity(documents: DataFrame, name: str, tenant: str = "") -> DataFrame:
    """Documents of a single entity."""
    keep = F.col("bucket") == name
    if tenant:
        keep &= F.col("tenant") == tenant
    return documents.filter(keep)

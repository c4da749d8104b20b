"""Items of JSON arrays in files of any size, read by many tasks.

Spark splits the text at closing braces, wherever they stand. Whether a part begins inside a string, and how deep it lies, follows from all parts before it
in the file, but both are sums: quotes flip the first, brackets add to the second. They are summed inside each split of the file, for either
state it may begin in, and then over the splits' totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.session import materialize

_SPLIT = ["path", "start"]


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _parts(raw: DataFrame) -> DataFrame:
    """Adds flips (whether the part has an odd number of quotes), and what it and the brace after it add to the depth if it begins outside
    (out) or inside (into) a string. Closing braces never stand in a part."""
    plain = F.regexp_replace("part", r"(?s)\\.", "")
    odd = _count(F.col("plain"), '"') % 2

    def added(rest: Column, ends_inside: Column) -> Column:
        bare = F.regexp_replace(rest, r'"[^"]*+(?:"|\z)', "")
        return (_count(bare, "{") + _count(bare, "[") - _count(bare, "]") - F.when(ends_inside, 0).otherwise(1)).cast("long")

    rows = raw.withColumn("plain", plain).withColumn("flips", odd.cast("long"))
    inside = F.regexp_replace("plain", r'^[^"]*+(?:"|\z)', "")
    return rows.withColumn("out", added(F.col("plain"), F.col("flips") == 1)).withColumn("into", added(inside, F.col("flips") == 0)).drop("plain")


def read_array_items(spark: SparkSession, paths: str | Sequence[str], *, pattern: str = "*.json") -> DataFrame:
    """`path, ordinal, item`: the objects of the JSON array in each file, in order, as JSON text.

    Items that are no objects are skipped, and so is what a cut file ends in. A file without a closing brace has no items. A task never holds more than
    a split of a file and whole items.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "}").text([paths] if isinstance(paths, str) else list(paths))
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("part"))
    )
    rows = materialize(_parts(raw), "array-parts")
    order = Window.partitionBy(*_SPLIT).orderBy("seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    # The state of each part, and the depth after it, if the split begins outside a string (0) or inside one (1).
    rows = rows.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    adds = [F.when((F.col("inside") + begins) % 2 == 0, F.col("out")).otherwise(F.col("into")) for begins in (0, 1)]
    rows = rows.withColumns({f"depth{k}": F.sum(a).over(upto) for k, a in enumerate(adds)})
    totals = rows.groupBy(*_SPLIT).agg(F.sum("flips").alias("flips"), *[F.max_by(f"depth{k}", "seq").alias(f"depth{k}") for k in (0, 1)], F.max("seq").alias("last"))
    files = Window.partitionBy("path").orderBy("start")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("begins", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("begins") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    totals = totals.select(*_SPLIT, "begins", F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("above"), F.when(F.lead("start").over(files).isNull(), F.col("last")).alias("end"))
    rows = rows.join(totals, _SPLIT)
    depth = F.col("above") + F.when(F.col("begins") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    outside = (F.col("inside") + F.col("begins") + F.col("flips")) % 2 == 0
    closes = outside & (depth == 1) & ~F.col("seq").eqNullSafe(F.col("end"))
    rows = materialize(rows.select(*_SPLIT, "seq", "part", closes.cast("long").alias("closes")), "array-depths")
    # An item is the parts up to the one that closes it.
    counts = rows.groupBy(*_SPLIT).agg(F.sum("closes").alias("closes")).select(*_SPLIT, F.coalesce(F.sum("closes").over(earlier), F.lit(0)).alias("items"))
    numbered = rows.withColumn("own", F.coalesce(F.sum("closes").over(before), F.lit(0))).join(counts, _SPLIT)
    whole = numbered.groupBy("path", (F.col("own") + F.col("items")).alias("place")).agg(F.array_sort(F.collect_list(F.struct("start", "seq", "part"))).alias("parts"), F.max("closes").alias("closes"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["part"]), "}"), F.lit("}"))
    items = whole.where("closes = 1").select("path", F.col("place").alias("ordinal"), F.regexp_replace(text, r"^[^{]*+", "").alias("item"))
    return items.where(F.startswith(F.schema_of_variant(F.try_parse_json("item")), F.lit("OBJECT")))

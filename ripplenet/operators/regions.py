"""Regional comparison of two cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.functions.places import us_state_part
from ripplenet.storage import small_table

# Rows the published table always shows, and rows its maps leave out.
REQUIRED_REGIONS = ("idaho", "south dakota")
EXCLUDED_REGIONS = ("district of columbia", "dc", "new england")


def split_cohorts(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users of ``predictions(v, label)`` with the label (anything but ``0.0``) and without it (numerically zero)."""
    ill = predictions.where(F.col("label") != "0.0").select("v")
    well = predictions.where(F.col("label").try_cast("double") == 0.0).select("v")
    return ill.distinct(), well.distinct()


def cohort_locations(users: DataFrame, cohort: DataFrame, longer_than: int = 2) -> DataFrame:
    """``users(v, location)`` of a cohort with a usable location, lower-cased."""
    usable = users.where(F.length("location") > longer_than)
    return usable.join(cohort.select("v"), "v", "left_semi").select("v", F.lower("location").alias("location"))


def unknown_locations(locations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Distinct locations still to be geocoded."""
    return locations.select("location").distinct().join(lookup.select("location"), "location", "left_anti")


def normalise_states(addresses: DataFrame, states: DataFrame) -> DataFrame:
    """Add ``region`` to US ``addresses(address, ...)``: abbreviations become names, everything else stays."""
    found = addresses.withColumn("_part", us_state_part(F.col("address"))).where(F.col("_part").isNotNull())
    names = states.select(F.lower("abbreviation").alias("_part"), F.lower("name").alias("_name"))
    return found.join(names, "_part", "left").withColumn("region", F.coalesce("_name", F.lower("_part"))).drop("_part", "_name")


def state_distribution(locations: DataFrame, lookup: DataFrame, states: DataFrame) -> DataFrame:
    """``(region, n)``: users per US state, by way of the ``lookup(location, address)`` of formatted addresses.

    Users are counted per location before the lookup, so a location shared by a third of them is one row.
    """
    counted = locations.groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    addressed = counted.join(lookup.select("location", F.lower("address").alias("address")), "location")
    return normalise_states(addressed, states).groupBy("region").agg(F.sum("n").alias("n"))


def cohort_table(ill: DataFrame, well: DataFrame, required: Sequence[str] = REQUIRED_REGIONS) -> DataFrame:
    """``(region, or18, well)``: counts ``(region, n)`` of both cohorts, 0 where absent, one row per region."""
    both = ill.select("region", F.col("n").alias("or18")).join(
        well.select("region", F.col("n").alias("well")), "region", "full"
    )
    if required:
        always = small_table(ill.sparkSession, ["region", "or18", "well"], [(r, 0, 0) for r in required])
        both = both.unionByName(always)
    return (
        both.groupBy("region")
        .agg(F.coalesce(F.sum("or18"), F.lit(0)).alias("or18"), F.coalesce(F.sum("well"), F.lit(0)).alias("well"))
    )


def cohort_percentage(table: DataFrame, excluded: Sequence[str] = EXCLUDED_REGIONS) -> DataFrame:
    """``(region, res)``: 100 a / (a + b); undefined (null) where the first cohort is empty, as in the maps."""
    share = F.when(F.col("or18") > 0, 100 * F.col("or18") / (F.col("well") + F.col("or18")))
    return table.where(~F.col("region").isin(list(excluded))).select("region", "or18", "well", share.alias("res"))


def merge_regions(shapes: DataFrame, table: DataFrame) -> DataFrame:
    """Inner merge of map shapes and a region table."""
    return shapes.join(table, "region")

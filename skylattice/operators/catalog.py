"""Catalogue filters, searches and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.sources.readers import scratch

from .spatial import by_shuffle, spatial_join

#: Rows of the first slice of a search for each row wanted, and how many times as many the next ones take.
SLICE, WIDER = 4096, 16


def open_window(ts: Column, start: str, end: str) -> Column:
    """Strictly between the first day's midnight and the last second of the last day."""
    return (ts > F.lit(f"{start} 00:00:00").cast("timestamp_ntz")) & (ts < F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))


def closed_window(ts: Column, start: str, end: str) -> Column:
    return ts.between(F.lit(f"{start} 00:00:00").cast("timestamp_ntz"), F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))


def half_open_window(ts: Column, start: str, end: str) -> Column:
    """The last day is left out."""
    return (ts >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz")) & (ts < F.lit(f"{end} 00:00:00").cast("timestamp_ntz"))


def acquired(day: Column, start: str | None, end: str | None) -> Column:
    """Whole days, both included; a bound that is missing or empty does not bind."""
    out = F.lit(True)
    if start:
        out &= day >= F.lit(start).cast("date")
    if end:
        out &= day <= F.lit(end).cast("date")
    return out


def with_default_dates(requests: DataFrame, as_of: str, *, start: str = "start_date", end: str = "end_date", days: int | None = 30, since: str = "2020-01-01") -> DataFrame:
    """Missing or empty dates become the last ``days`` before ``as_of`` (or ``since``, if ``days`` is None) up to it."""
    first = F.date_sub(F.lit(as_of).cast("date"), days).cast("string") if days is not None else F.lit(since)
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return requests.withColumns({start: F.coalesce(given(start), first), end: F.coalesce(given(end), F.lit(as_of))})


def has_attribute(attributes: Column, name: str, value: str) -> Column:
    """Some attribute has this name and value."""
    return F.exists(attributes, lambda a: (a["name"] == name) & (a["value"] == value))


def scene_matches(display_id: Column, bulk: Column, metadata: Column, product: str) -> Column:
    """Bulk scenes of a product code such as ``8L2SP``: the satellite's digit, then what the display id must hold."""
    satellite = F.exists(metadata, lambda m: (m["name"] == "Satellite") & (m["value"].try_cast("int") == int(product[0])))
    return (F.coalesce(bulk, F.lit(False))) & F.contains(display_id, F.lit(product[1:])) & satellite


def newest(df: DataFrame, by: list[str], ts: str, key: str, k: int) -> DataFrame:
    """The ``k`` newest rows of each group with their ``rank``; equal times in order of ``key``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts), key))).where(F.col("rank") <= k)


def _cuts(df: DataFrame, by: str, descending: bool, k: int) -> list:
    """Values of ``by`` that cut a table into slices, from its first rows on in this order: of about ``SLICE`` rows for each of
    ``k``, then ``WIDER`` times as many, and so on. They come from an approximate sketch; where they lie is of no matter to a
    result."""
    n, sizes = df.count(), [SLICE * k]
    while sizes[-1] * 2 < n:
        sizes.append(sizes[-1] * WIDER)
    shares = [x / n for x in sizes if x * 2 < n]
    if not shares:
        return []
    at = F.array(*(F.lit(1 - x if descending else x) for x in shares))
    return df.agg(F.percentile_approx(by, at, F.lit(100000)).alias("at")).first().at or []


def first_met(catalogue: DataFrame, areas: DataFrame, by: str, key: str, k: int, *, descending: bool = False, area_id: str = "aoi_id", levels: list[int] | None = None) -> DataFrame:
    """The first ``k`` products in order of ``by`` and ``key`` whose footprint meets each area, with their ``rank``.

    The catalogue is searched in slices that follow this order, each for the areas that are not served yet, so that an area
    costs a few times ``k`` pairs and not all that it meets. A slice has all rows of its span of ``by``; areas that meet fewer
    than ``k`` go through all slices. What a slice gives is written to the scratch folder. A catalogue of few rows is one slice.
    """
    spark, col = catalogue.sparkSession, F.col(by)
    order = [F.desc(by) if descending else F.asc(by), key]
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(area_id).orderBy(*order))).where(F.col("rank") <= k)
    cuts = _cuts(catalogue, by, descending, k)
    # Nulls come first in ascending order and last in descending order.
    upto = [(col >= F.lit(v)) if descending else (col <= F.lit(v)) for v in cuts]
    upto = [F.coalesce(c, F.lit(not descending)) for c in upto] + [F.lit(True)]
    parts: list[DataFrame] = []
    rest, carried = areas, None
    for i, within in enumerate(upto):
        found = spatial_join(catalogue.where(within & ~upto[i - 1] if i else within), rest, levels=levels)
        out = ranked(found if carried is None else carried.unionByName(found))
        if i == len(upto) - 1:
            parts.append(out)
            break
        path = scratch(spark, "slice")
        out.write.parquet(path)
        out = spark.read.schema(out.schema).parquet(path)
        served = out.where(F.col("rank") == k).select(area_id)
        rest = rest.join(by_shuffle(served), area_id, "left_anti")
        if rest.isEmpty():
            parts.append(out)
            break
        parts.append(out.join(by_shuffle(served), area_id, "left_semi"))
        carried = out.join(by_shuffle(served), area_id, "left_anti").drop("rank")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def search(catalogue: DataFrame, areas: DataFrame, *, k: int = 1000, area_id: str = "aoi_id", ts: str = "start_ts", key: str = "scene_id", levels: list[int] | None = None) -> DataFrame:
    """Newest ``k`` products whose footprint meets each area."""
    return first_met(catalogue, areas, ts, key, k, descending=True, area_id=area_id, levels=levels)

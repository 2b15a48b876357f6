"""Adapters from each provider's answers to the one normalised catalogue, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions import geometry as G
from skylattice.operators import files as N

#: Columns of the normalised catalogue; what a provider does not tell is null.
NORMALISED = {
    "provider": "string", "collection": "string", "product_id": "string", "name": "string", "product_type": "string", "tile_id": "string", "start_ts": "timestamp_ntz", "ring": "array<struct<x:double,y:double>>",
    "bbox": "struct<xmin:double,ymin:double,xmax:double,ymax:double>", "bulk": "boolean", "attrs": "array<struct<name:string,value:string>>", "links": "array<struct<href:string,rel:string>>", "content_length": "bigint",
}


def _shaped(df: DataFrame, provider: str, **columns: Column) -> DataFrame:
    ring = columns.get("ring")
    known = columns | {"provider": F.lit(provider)} | ({"bbox": F.when(ring.isNotNull(), G.bounds(ring))} if ring is not None else {})
    return df.select(*(known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in NORMALISED.items()))


def _attribute(attrs: Column, name: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["name"] == name), 0)["value"]


def copernicus(products: DataFrame) -> DataFrame:
    """Products as ``readers.products`` gives them."""
    attrs = F.transform("Attributes", lambda a: F.struct(a["Name"].alias("name"), a["Value"].alias("value")))
    # Each column of a box would parse the text anew.
    products, ring = G.hold(products, _ring=G.from_wkt(F.regexp_extract("Footprint", r"(?i)POLYGON.*\)\)", 0))), F.col("_ring")
    return _shaped(products, "copernicus", collection=F.col("Collection.Name"), product_id=F.col("Id"), name=F.col("Name"), product_type=_attribute(attrs, "productType"), tile_id=_attribute(attrs, "tileId"), start_ts=F.col("ContentDate.Start"), ring=ring, attrs=attrs, content_length=F.col("ContentLength"))


def usgs(scenes: DataFrame, collection: str = "landsat_ot_c2_l2") -> DataFrame:
    """Scenes as ``readers.scenes`` gives them; the product type is the second part of the display id."""
    attrs = F.transform("metadata", lambda a: F.struct(a["fieldName"].alias("name"), a["value"].alias("value")))
    return _shaped(scenes, "usgs", collection=F.lit(collection), product_id=F.col("entityId"), name=F.col("displayId"), product_type=F.split_part("displayId", F.lit("_"), F.lit(2)), bulk=F.col("options.bulk"), attrs=attrs)


def modis(granules: DataFrame) -> DataFrame:
    """Granules as ``readers.granules`` gives them."""
    return _shaped(granules, "modis", product_id=F.col("id"), links=F.col("links"))


def gee(images: DataFrame) -> DataFrame:
    """Images ``id, collection, start_ts``."""
    return _shaped(images, "gee", collection=F.col("collection"), product_id=F.col("id"), name=N.last_part(F.col("id")), start_ts=F.col("start_ts"))


def cds(requests: DataFrame) -> DataFrame:
    """Daily requests ``day, variable, file_name``."""
    return _shaped(requests, "cds", product_id=F.col("file_name"), name=F.col("file_name"), product_type=F.col("variable"), start_ts=F.col("day"))


def opentopography(requests: DataFrame) -> DataFrame:
    """Elevation requests ``demtype, ring, url, file_name``."""
    return _shaped(requests, "opentopography", product_id=F.col("file_name"), name=F.col("file_name"), product_type=F.col("demtype"), ring=F.col("ring"), links=F.array(F.struct(F.col("url").alias("href"), F.lit("data").alias("rel"))))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"copernicus": copernicus, "usgs": usgs, "modis": modis, "gee": gee, "cds": cds, "opentopography": opentopography}


def normalise(provider: str, answers: DataFrame) -> DataFrame:
    """Answers of a provider, by its name in any case, as rows of the normalised catalogue."""
    if provider.lower() not in ADAPTERS:
        raise ValueError(f"unknown provider {provider}; known are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[provider.lower()](answers)


def catalogue(**answers: DataFrame) -> DataFrame:
    """The normalised catalogue of several providers' answers."""
    return reduce(DataFrame.unionByName, (normalise(name, df) for name, df in answers.items()))

"""Names, addresses, layouts and archive checks, as Column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geometry import let

#: Suffixes of the files that are clipped for a provider. Fixed values.
CLIPPED = {"usgs": (".tif", ".tiff"), "copernicus": (".jp2",), "opentopography": (".tif",)}


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def output_layout(key: Column, start: Column, end: Column, provider: Column, collection: Column, product_type: Column) -> Column:
    """``downloads/md5(key)/start_end/provider/collection/product_type`` without the parts that are missing or empty."""
    days = _given(F.concat_ws("_", _given(F.replace(start, F.lit("/"), F.lit(""))), _given(F.replace(end, F.lit("/"), F.lit("")))))
    return F.concat_ws("/", F.lit("downloads"), F.md5(key), days, _given(provider), _given(collection), _given(product_type))


def store_address(bucket: str, namespace: str, name: Column) -> Column:
    return F.concat(F.lit(f"oci://{bucket}@{namespace}/"), name)


def last_part(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def path_name(url: Column) -> Column:
    """Last part of the URL's path, without query and fragment."""
    return last_part(F.coalesce(F.parse_url(url, F.lit("PATH")), url))


def disposition_name(header: Column) -> Column:
    """File name of a Content-Disposition header, null if it has none."""
    named = F.regexp_replace(F.substring_index(header, "filename=", -1), '^"+|"+$', "")
    return F.when(F.contains(header, F.lit("filename=")), named)


def dem_url(base: str, demtype: Column, box: Column, output: str = "GTiff") -> Column:
    """Elevation request for a box ``xmin, ymin, xmax, ymax``; the access key is left to the sender."""
    text = lambda c: F.url_encode(c.cast("string"))
    pairs = (("demtype", demtype), ("south", box.ymin), ("north", box.ymax), ("west", box.xmin), ("east", box.xmax), ("outputFormat", F.lit(output)))
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *(F.concat(F.lit(k + "="), text(v)) for k, v in pairs)))


def dem_name(url: Column) -> Column:
    return F.concat(F.parse_url(url, F.lit("QUERY"), F.lit("demtype")), F.lit("_"), F.md5(url), F.lit(".tif"))


def archive_base(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)(\.tar\.gz|\.tgz|\.tar|\.zip)$", "")


def archive_mode(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.endswith(low, F.lit(".tar.gz")) | F.endswith(low, F.lit(".tgz")), "gz").when(F.endswith(low, F.lit(".tar")), "plain").otherwise("auto")


def leaves_base(member: Column) -> Column:
    """Whether a member's path is absolute or climbs out of the folder it is unpacked in."""
    depths = F.aggregate(
        F.split(member, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad")),
        lambda s, part: F.struct((s.depth + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("depth"), (s.bad | ((part == "..") & (s.depth <= 0))).alias("bad")),
    )
    return F.startswith(member, F.lit("/")) | depths.bad


def unsafe_archives(members: DataFrame) -> DataFrame:
    """Archives with any unsafe member."""
    return members.groupBy("archive").agg(F.bool_or(leaves_base(F.col("member_name"))).alias("unsafe")).where("unsafe").select("archive")


def clipped(provider: Column, name: Column) -> Column:
    """Whether a provider's file is one to clip."""
    low, out = F.lower(name), F.lit(False)
    for known, suffixes in CLIPPED.items():
        for suffix in suffixes:
            out = out | ((provider == known) & F.endswith(low, F.lit(suffix)))
    return out


def daily_requests(start: Column, end: Column) -> Column:
    """Every day from ``start`` to ``end``, none if they are the wrong way round."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(F.expr("array()").cast("array<date>"))


def progress(line: Column, strict: bool = False) -> Column:
    """``name, percent, done, total`` of a progress line, null for any other line. A resumed download counts as one, unless
    ``strict``."""
    # Both kinds of line: description, percent, bar, counts, and times in brackets with a speed behind them at most.
    bar = r"^([^|]*\S) *: *(\d{1,3})%\|[^\[]*\| *([^\s/|]+)/([^\s/|]+) *\[ *([0-9:?]+)<([^\]]*)\](.*)$"
    # One look at the line: a match is written as its parts, and what is no match has none.
    parts = F.split(F.regexp_replace(F.replace(line, F.lit("\x01"), F.lit(" ")), bar, "\x01".join(f"${i}" for i in range(1, 8))), "\x01")
    counts, sizes = r"^\d+$", r"^[0-9.]+[kMGTP]?$"

    def kinds(v: Column) -> Column:
        part = lambda i: F.get(v.parts, i - 1)
        both = lambda kind: F.rlike(part(3), F.lit(kind)) & F.rlike(part(4), F.lit(kind))
        batch = (part(1) == "Concurrent Downloads") & both(counts) & (part(6) != "") & F.rlike(part(7), F.lit(r"^\s*\S*$"))
        name = F.regexp_extract(part(1), r"^Downloading +(.*)$" if strict else r"^(?:Downloading|Resuming) +(.*)$", 1)
        single = (name != "") & both(sizes) & F.rlike(part(6), F.lit(r"^[0-9:?-]+(,.*)?$")) & ~F.contains(part(5), F.lit("?"))
        row = lambda name: F.struct(name.alias("name"), part(2).cast("int").alias("percent"), part(3).alias("done"), part(4).alias("total"))
        return F.when(F.size(v.parts) < 7, None).when(batch, row(part(1))).when(single, row(name))

    return let(kinds, parts=parts)

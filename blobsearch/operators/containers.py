"""Container listings: patches, their ids and kinds; JSON metadata and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsearch.functions import files


def explode_patches(listing: DataFrame) -> DataFrame:
    """One row for each patch of quilt_id, identifier, tags: blob_id, extension, kind; repeats inside a container once.

    Kind by priority: audio, video or image by extension, then tag, then other extensions, then unknown.
    """
    ext = files.extension_of("identifier")
    by_ext, by_tag = files.kind_from_extension("extension"), files.kind_from_tags(F.col("tags"))
    kind = F.when(by_ext.isin("audio", "video", "image"), by_ext).otherwise(F.coalesce(by_tag, by_ext, F.lit("unknown")))
    valid = listing.where(F.col("quilt_id").isNotNull() & F.col("identifier").isNotNull())
    each = valid.groupBy("quilt_id", "identifier").agg(F.min_by("tags", F.to_json("tags")).alias("tags")) if "tags" in listing.columns else valid.select("quilt_id", "identifier", F.lit(None).cast("map<string,string>").alias("tags")).distinct()
    return each.withColumn("blob_id", F.concat_ws("::", "quilt_id", "identifier")).withColumn("extension", ext).withColumn("kind", kind)


def tags_to_json(tags: Column) -> Column:
    """Tags as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def metadata(json: Column | str) -> Column:
    """Variant of JSON metadata, also where it was encoded twice; null if it is no object."""
    once = F.try_parse_json(json)
    text = F.try_variant_get(once, "$", "string")
    object_text = F.when(F.schema_of_variant(once) == "STRING", text)
    value = F.coalesce(F.try_parse_json(object_text), once)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def path_value(v: Column, path: str, kind: str = "string") -> Column:
    """A nested value; objects may be wrapped in ``fields``: storage.end_epoch is also sought as storage.fields.end_epoch."""
    parts = path.split(".")
    wrapped = ".".join([*parts[:-1], "fields", parts[-1]]) if len(parts) > 1 else f"fields.{path}"
    return F.coalesce(F.try_variant_get(v, f"$.{wrapped}", kind), F.try_variant_get(v, f"$.{path}", kind))

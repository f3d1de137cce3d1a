"""Landed files and pages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blobsearch.operators.containers import path_value

# Names under which listings give one attribute, in the order of preference.
ID_KEYS = ("blobIdBase64", "blob_id_base64", "blobId", "blob_id", "id")
END_KEYS = ("endEpoch", "end_epoch", "expiryEpoch")
SIZE_KEYS = ("size", "blob_size")
OWNER_KEYS = ("owner", "ownerAddress")


def first_value(v: Column, keys: tuple[str, ...]) -> Column:
    """The first of several keys that holds more than '' or 0."""
    each = [F.try_variant_get(v, f"$.{k}", "string") for k in keys]
    return F.coalesce(*[F.when(~x.isin("", "0"), x) for x in each])


def normalize_listing(items: DataFrame, item: str = "item") -> DataFrame:
    """blob_id, end_epoch, size, owner, deletable from JSON items of any spelling; items without an id go."""
    v = F.try_parse_json(item)
    out = items.withColumn("_v", v).select(
        *[c for c in items.columns if c != item], first_value(F.col("_v"), ID_KEYS).alias("blob_id"),
        first_value(F.col("_v"), END_KEYS).alias("_end"), first_value(F.col("_v"), SIZE_KEYS).alias("_size"), first_value(F.col("_v"), OWNER_KEYS).alias("owner"),
        F.coalesce(F.try_variant_get("_v", "$.deletable", "boolean"), F.lit(False)).alias("deletable"),
    )
    return out.where("blob_id is not null").withColumn("end_epoch", F.expr("try_cast(_end AS BIGINT)")).withColumn("size", F.expr("try_cast(_size AS BIGINT)")).drop("_end", "_size")


def object_nodes(nodes: DataFrame, node: str = "node") -> DataFrame:
    """blob_id, size, end_epoch of chain objects; nodes without contents go."""
    v = path_value(F.try_parse_json(node), "asMoveObject.contents.json", "variant")
    out = nodes.withColumn("_v", v)
    return out.select(
        *[c for c in nodes.columns if c != node], F.try_variant_get("_v", "$.blob_id", "string").alias("blob_id"), F.try_variant_get("_v", "$.size", "bigint").alias("size"),
        path_value(F.col("_v"), "storage.end_epoch", "bigint").alias("end_epoch"),
    ).where("blob_id is not null")


def union_sources(**sources: DataFrame) -> DataFrame:
    """Rows of several sources with their name; columns that one lacks are null."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """blob_id (from the file's name; '__' stands for '::') and content of landed payload files."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(F.replace(F.url_decode(name), F.lit("__"), F.lit("::")).alias("blob_id"), "content", F.col("length").alias("size"))


def payload_prefix(df: DataFrame, n: int = 8192) -> DataFrame:
    """blob_id, prefix, total: the first n bytes; the size after '/' of a content range, else the content's own."""
    told = F.expr("try_cast(regexp_extract(content_range, '/([0-9]+)$', 1) AS BIGINT)")
    return df.select("blob_id", F.substring("content", 1, n).alias("prefix"), F.coalesce(told, F.length("content").cast("long")).alias("total"))


def caption_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_id, file_name, captions (in order of id) of images that have any."""
    caps = annotations.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "caption"))), lambda c: c["caption"]).alias("captions"))
    return images.join(caps, images["id"] == caps["image_id"]).select("image_id", "file_name", "captions")


def split_annotations(images: DataFrame, split: str) -> DataFrame:
    """image_id, file_name, captions of one split; ids under either of two names."""
    return images.where(F.col("split") == split).select(F.coalesce("cocoid", "imgid").alias("image_id"), F.col("filename").alias("file_name"), F.transform("sentences", lambda s: F.trim(s["raw"])).alias("captions"))


def moment_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """vid, gt_start, gt_end, sentence from lines 'vid start end##sentence'; other lines go."""
    head, text = F.split(F.trim(F.substring_index(line, "##", 1)), r"\s+"), F.regexp_replace(line, "(?s)^.*?##", "")
    rows = lines.where(F.col(line).contains("##")).select(head.alias("h"), F.trim(text).alias("sentence")).where(F.size("h") >= 3)
    return rows.select(F.col("h")[0].alias("vid"), F.expr("try_cast(h[1] AS DOUBLE)").alias("gt_start"), F.expr("try_cast(h[2] AS DOUBLE)").alias("gt_end"), "sentence")


def class_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """class_id, class_name, label from rows '| id | name |' of a markdown table; ids 0 to 999."""
    cell = lambda i: F.regexp_extract(F.trim(line), r"^\|\s*(\d+)\s*\|\s*([^|]+?)\s*\|", i)
    rows = lines.select(cell(1).alias("c"), cell(2).alias("class_name"))
    rows = rows.where("c <> ''").withColumn("class_id", F.expr("try_cast(c AS INT)")).where("class_id between 0 and 999")
    return rows.select("class_id", "class_name", F.trim(F.substring_index("class_name", ",", 1)).alias("label"))


def id_list(lines: DataFrame, line: str = "value", length: int | None = 43, order: str = "n") -> DataFrame:
    """Different trimmed ids of the right length, each at its first line."""
    rows = lines.select(F.trim(line).alias("blob_id"), order).where(F.col("blob_id") != "")
    if length:
        rows = rows.where(F.length("blob_id") == length)
    return rows.groupBy("blob_id").agg(F.min(order).alias(order))


def preferred_ids(active: DataFrame, every: DataFrame, limit: int | None = None, length: int | None = 43, order: str = "n") -> DataFrame:
    """The ids of the list of active ones if it holds any, else those of the list of all; with a limit the first so many of them."""
    a, b = id_list(active, length=length, order=order), id_list(every, length=length, order=order)
    some = F.broadcast(a.agg((F.count("*") > 0).alias("_some")))
    ids = a.unionByName(b.crossJoin(some).where(~F.col("_some")).drop("_some"))
    return ids.orderBy(order, "blob_id").limit(limit) if limit is not None else ids


def decode_text(content: Column | str, most: int = 10 << 20) -> Column:
    """Bytes as UTF-8 text, bad sequences replaced, cut at ``most`` bytes."""
    return F.make_valid_utf8(F.substring(content, 1, most).cast("string"))


def newest_first(df: DataFrame, order: str, key: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")



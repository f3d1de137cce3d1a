"""Sources, file types, containers and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from blobsearch.functions import files as X
from blobsearch.functions import ranges as R
from blobsearch.operators import catalog as C
from blobsearch.operators import containers as K
from blobsearch.sources import landing as L

from .registry import _hex, query

_FTYP = f"CASE WHEN substr(h, 9, 8) = '{_hex('ftyp')}' THEN substr(h, 17, 8) END"
_SNIFF = f"""
SELECT blob_id, CASE WHEN h = '' THEN 'bin' WHEN starts_with(h, '{_hex("fLaC")}') THEN 'flac' WHEN regexp_matches(h, '^FFF[0189]') THEN 'aac' WHEN starts_with(h, '{_hex("ID3")}') OR regexp_matches(h, '^FF[EF]') THEN 'mp3'
  WHEN starts_with(h, '{_hex("OggS")}') AND contains(h, '{_hex("theora")}') THEN 'ogv' WHEN starts_with(h, '{_hex("OggS")}') THEN 'ogg'
  WHEN starts_with(h, '1A45DFA3') AND contains(h, '{_hex("webm")}') THEN 'webm' WHEN starts_with(h, '1A45DFA3') THEN 'mkv'
  WHEN starts_with(h, '{_hex("RIFF")}') AND substr(h, 17, 8) = '{_hex("WAVE")}' THEN 'wav' WHEN starts_with(h, '{_hex("RIFF")}') AND substr(h, 17, 8) = '{_hex("AVI ")}' THEN 'avi' WHEN starts_with(h, '{_hex("RIFF")}') AND substr(h, 17, 8) = '{_hex("WEBP")}' THEN 'webp'
  WHEN starts_with(h, '000001BA') THEN 'mpg' WHEN starts_with(h, '464C5601') THEN 'flv'
  WHEN {_FTYP} = '{_hex("heic")}' THEN 'heic' WHEN {_FTYP} = '{_hex("avif")}' THEN 'avif' WHEN {_FTYP} = '{_hex("M4A ")}' THEN 'm4a'
  WHEN {_FTYP} IS NOT NULL AND contains(h, '{_hex("soun")}') AND NOT contains(h, '{_hex("vide")}') THEN 'm4a' WHEN {_FTYP} IS NOT NULL THEN 'mp4'
  WHEN starts_with(h, '{_hex("%PDF-")}') THEN 'pdf' WHEN starts_with(h, '89504E47') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpg' WHEN starts_with(h, '{_hex("GIF89a")}') THEN 'gif' WHEN starts_with(h, '{_hex("BM")}') THEN 'bmp'
  WHEN starts_with(h, '49492A00') THEN 'tiff' WHEN starts_with(h, '377ABCAF271C') THEN '7z' WHEN starts_with(h, '1F8B') THEN 'gz' WHEN starts_with(h, '504B0304') THEN 'zip'
  WHEN regexp_matches(substr(h, 1, 32), '^(..)*00') OR starts_with(h, 'C328') THEN 'bin' ELSE 'txt' END AS extension
FROM v_payloads
"""


def _sniffed(t):
    # the stand-in's head is itself a long CASE: bound once, so that it is not copied into every rule
    found = F.transform(F.array("h"), lambda h: X.sniff(h, F.length(h) / 2))[0]
    return t.v_payloads.select("blob_id", found.alias("s")).select("blob_id", "s.*")


@query("sniff_type", _SNIFF)
def _(t):
    return _sniffed(t).select("blob_id", "extension")


@query("sniff_isobmff", f"SELECT extension, CAST(count(*) AS BIGINT) AS n FROM ({_SNIFF}) WHERE extension IN ('m4a', 'mp4', 'heic', 'avif') GROUP BY 1")
def _(t):
    return _sniffed(t).where(F.col("extension").isin("m4a", "mp4", "heic", "avif")).groupBy("extension").agg(F.count("*").alias("n"))


@query("kind_from_mime", "SELECT blob_id, CASE WHEN mime_type = 'application/x-walrus-quilt' THEN 'quilt' WHEN mime_type IS NULL THEN 'binary' ELSE split_part(mime_type, '/', 1) END AS kind FROM v_blobs")
def _(t):
    return t.v_blobs.select("blob_id", X.kind_from_mime(F.coalesce("mime_type", F.lit(""))).alias("kind"))


@query("mime_to_ext", "SELECT k, CASE mime WHEN 'image/x-png' THEN 'png' WHEN 'application/vnd.ms-excel' THEN 'xls' WHEN 'application/atom+xml' THEN 'atom' WHEN 'text/plain' THEN 'txt' ELSE 'bin' END AS ext FROM v_names")
def _(t):
    return t.v_names.select("k", X.extension_from_mime("mime").alias("ext"))


_EXT = "lower(regexp_extract(split_part(identifier, '/', -1), '\\.([A-Za-z0-9]{1,8})$', 1))"
_KIND = "CASE WHEN {0} = 'png' THEN 'image' WHEN {0} = 'mp3' THEN 'audio' WHEN {0} = 'mp4' THEN 'video' WHEN {0} = 'parquet' THEN 'data' END"


@query("ext_from_identifier", f"SELECT quilt_id, identifier, {_EXT} AS ext FROM v_patches")
def _(t):
    return t.v_patches.select("quilt_id", "identifier", X.extension_of("identifier").alias("ext"))


@query("kind_from_ext", f"SELECT quilt_id, identifier, {_KIND.format(_EXT)} AS kind FROM v_patches")
def _(t):
    return t.v_patches.select("quilt_id", "identifier", X.kind_from_extension(X.extension_of("identifier")).alias("kind"))


def _tagged(t):
    tags = F.when(F.col("content_type").isNotNull(), F.create_map(F.lit("content_type"), "content_type"))
    return t.v_patches.select("quilt_id", "identifier", tags.alias("tags"))


@query("kind_from_tags", "SELECT quilt_id, identifier, CASE WHEN content_type LIKE '%/%' THEN lower(split_part(content_type, '/', 1)) END AS kind FROM v_patches")
def _(t):
    return _tagged(t).select("quilt_id", "identifier", X.kind_from_tags(F.col("tags")).alias("kind"))


@query("explode_patches", f"SELECT DISTINCT concat(quilt_id, '::', identifier) AS blob_id, {_EXT} AS extension, CASE WHEN {_KIND.format(_EXT)} IN ('image', 'audio', 'video') THEN {_KIND.format(_EXT)} ELSE coalesce(split_part(content_type, '/', 1), {_KIND.format(_EXT)}, 'unknown') END AS kind FROM v_patches")
def _(t):
    return K.explode_patches(_tagged(t)).select("blob_id", "extension", "kind")


@query("tags_to_columns", "SELECT quilt_id, identifier, content_type AS tag_content_type, CASE WHEN content_type IS NOT NULL THEN concat('{\"content_type\":\"', content_type, '\"}') END AS tags FROM v_patches")
def _(t):
    return _tagged(t).select("quilt_id", "identifier", F.try_element_at("tags", F.lit("content_type")).alias("tag_content_type"), K.tags_to_json(F.col("tags")).alias("tags"))


@query("audio_rescue", "SELECT k, CASE WHEN name LIKE '%.opus' THEN 'audio' ELSE 'application' END AS kind FROM v_names")
def _(t):
    return t.v_names.select("k", X.audio_rescue("name", F.lit("application")).alias("kind"))


@query("split_composite_id", "SELECT k, split_part(name, '::', 1) AS parent, substr(name, instr(name, '::') + 2) AS ident FROM v_names")
def _(t):
    return t.v_names.select("k", X.parent_of("name").alias("parent"), X.identifier_of("name").alias("ident"))


@query("shard_filter", "SELECT quilt_id, identifier FROM v_patches WHERE identifier NOT LIKE '%\\_shard=%' ESCAPE '\\' OR identifier LIKE '%\\_shard=0-%' ESCAPE '\\'")
def _(t):
    return t.v_patches.where(X.shard_filter("identifier", "headers")).select("quilt_id", "identifier")


@query("caption_from_id", "SELECT k, CASE CAST(k AS BIGINT) % 6 WHEN 0 THEN '' WHEN 1 THEN '.opus' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' WHEN 4 THEN '.parquet' ELSE '.verylongext' END AS tail, concat('red fox runs', CAST(CAST(k AS BIGINT) % 5 AS VARCHAR), CASE CAST(k AS BIGINT) % 6 WHEN 0 THEN '' WHEN 1 THEN '.opus' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' WHEN 4 THEN '.parquet' ELSE '.verylongext' END) AS caption FROM v_names")
def _(t):
    tail = F.regexp_replace(F.regexp_extract("name", r"runs[0-9](\..*)?$", 1), r"\.MP4", "")
    return t.v_names.select("k", tail.alias("tail"), X.caption_from_name("name").alias("caption"))


_BYTES = "list_aggregate(list_transform(range(0, 32), lambda i: CASE WHEN i < 16 THEN printf('%02x', CAST((CAST(concat(blob_id, '000000000000000000000') AS HUGEINT) >> (8 * least(i, 15))) & 255 AS INT)) ELSE '00' END), 'string_agg', '')"


@query("u256_to_base64url", f"SELECT blob_id, rtrim(replace(replace(base64(unhex({_BYTES})), '+', '-'), '/', '_'), '=') AS id FROM v_blobs")
def _(t):
    return t.v_blobs.select("blob_id", X.u256_to_base64url(F.concat("blob_id", F.lit("000000000000000000000"))).alias("id"))


_LISTED = """
SELECT k, page, concat('b', k) AS blob_id, CASE CAST(k AS BIGINT) % 3 WHEN 2 THEN NULL ELSE nullif(CAST(k AS BIGINT) % 60, 0) END AS end_epoch,
  CASE CAST(k AS BIGINT) % 3 WHEN 0 THEN nullif(CAST(k AS BIGINT) % 4 * 10, 0) WHEN 1 THEN 7 END AS size, CASE CAST(k AS BIGINT) % 3 WHEN 1 THEN '0x1' END AS owner, CAST(k AS BIGINT) % 3 = 1 AS deletable FROM v_items
"""


@query("normalize_listing", _LISTED)
def _(t):
    return L.normalize_listing(t.v_items).select("k", "page", "blob_id", "end_epoch", "size", "owner", "deletable")


@query("src_listing_pages", f"SELECT page, blob_id, size FROM ({_LISTED}) WHERE end_epoch > 30")
def _(t):
    return L.normalize_listing(t.v_items).where(C.is_active(30, "strict")).select("page", "blob_id", "size")


@query("src_listing_all", f"SELECT page, blob_id, coalesce(end_epoch > 30, FALSE) AS is_active FROM ({_LISTED})")
def _(t):
    return L.normalize_listing(t.v_items).select("page", "blob_id", C.is_active(30, "strict").alias("is_active"))


_NODES = "SELECT k, owner, concat('n', k) AS blob_id, CAST(k AS BIGINT) % 60 AS end_epoch, CASE WHEN CAST(k AS BIGINT) % 3 = 0 THEN CAST(k AS BIGINT) % 9 END AS size FROM v_nodes WHERE CAST(k AS BIGINT) % 3 <> 2"


@query("src_graphql_nodes", f"SELECT blob_id, size, end_epoch FROM ({_NODES}) WHERE end_epoch > 30")
def _(t):
    return L.object_nodes(t.v_nodes.select("k", "node", "owner")).where(C.is_active(30, "strict")).select("blob_id", "size", "end_epoch")


@query("src_owned_objects", f"SELECT blob_id, end_epoch FROM ({_NODES}) WHERE owner = '0x7'")
def _(t):
    return L.object_nodes(t.v_nodes.where("owner = '0x7'").select("k", "node")).select("blob_id", "end_epoch")


@query("json_path_extract", f"SELECT k, end_epoch FROM ({_NODES})")
def _(t):
    return L.object_nodes(t.v_nodes.select("k", "node")).select("k", "end_epoch")


@query("json_meta", "SELECT k, CAST(k AS BIGINT) % 100 AS size FROM v_nodes WHERE CAST(k AS BIGINT) % 4 IN (0, 1)")
def _(t):
    v = t.v_nodes.select("k", K.metadata("meta").alias("v")).where("v is not null")
    return v.select("k", F.try_variant_get("v", "$.size", "bigint").alias("size"))


@query("src_unified", f"SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(owner) AS BIGINT) AS owned FROM (SELECT 'listing' AS source, owner FROM ({_LISTED}) UNION ALL SELECT 'graphql', NULL FROM ({_NODES})) GROUP BY 1")
def _(t):
    both = L.union_sources(listing=L.normalize_listing(t.v_items), graphql=L.object_nodes(t.v_nodes.select("k", "node")))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("owner").alias("owned"))


@query("src_payload_prefix", "SELECT blob_id, substr(h, 1, 16) AS prefix, CAST(CASE WHEN CAST(blob_id AS BIGINT) % 2 = 0 THEN 5000 + CAST(blob_id AS BIGINT) ELSE length(h) / 2 END AS BIGINT) AS total FROM v_payloads")
def _(t):
    told = F.when(F.col("blob_id").cast("long") % 2 == 0, F.concat(F.lit("bytes 0-7/"), (F.col("blob_id").cast("long") + 5000).cast("string")))
    rows = t.v_payloads.select("blob_id", F.unhex("h").alias("content"), told.alias("content_range"))
    return L.payload_prefix(rows, 8).select("blob_id", F.hex("prefix").alias("prefix"), "total")


@query("src_caption_json", "SELECT conv_id AS image_id, concat('im', CAST(conv_id AS VARCHAR), '.jpg') AS file_name, list(text ORDER BY turn) AS captions FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(t):
    images = t.conversations.select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.format_string("im%d.jpg", "conv_id").alias("file_name"))
    ann = t.conversations.where("role = 'assistant'").select(F.col("turn").alias("id"), F.col("conv_id").alias("image_id"), F.col("text").alias("caption"))
    return L.caption_annotations(images, ann)


@query("src_split_json", "SELECT doc_id AS image_id, source AS file_name, list_transform(string_split(text, '.'), lambda x: trim(x)) AS captions FROM documents WHERE lang = 'de'")
def _(t):
    sentences = F.transform(F.split("text", r"\."), lambda s: F.struct(s.alias("raw")))
    rows = t.documents.select(F.lit(None).cast("long").alias("cocoid"), F.col("doc_id").alias("imgid"), F.col("source").alias("filename"), F.col("lang").alias("split"), sentences.alias("sentences"))
    return L.split_annotations(rows, "de")


@query("src_moment_anno", "SELECT concat('v', CAST(p_partkey AS VARCHAR)) AS vid, CAST(p_size % 5 AS DOUBLE) AS gt_start, CAST(p_size % 5 + 6 AS DOUBLE) AS gt_end, trim(p_name) AS sentence FROM part WHERE p_partkey % 3 <> 0")
def _(t):
    line = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("v"), F.col("p_partkey").cast("string"), F.lit(" "), (F.col("p_size") % 5).cast("string"), F.lit("  "), (F.col("p_size") % 5 + 6).cast("string"), F.lit("## "), "p_name"))
    return L.moment_lines(t.part.select(line.alias("value")))


@query("src_class_markdown", "SELECT CAST(p_partkey AS INT) AS class_id, concat(p_brand, ', ', p_type) AS class_name, p_brand AS label FROM part WHERE p_partkey <= 999")
def _(t):
    line = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_brand", F.lit(", "), "p_type", F.lit(" |"))
    return L.class_table(t.part.select(line.alias("value")))


@query("src_id_list", "SELECT rpad(concat('id', CAST(user_id AS VARCHAR)), 43, 'x') AS blob_id, min(event_id) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(t):
    value = F.when(F.col("event_type") == "error", "short").otherwise(F.concat(F.lit("  "), F.rpad(F.concat(F.lit("id"), F.col("user_id").cast("string")), 43, "x")))
    return L.id_list(t.events.select(value.alias("value"), F.col("event_id").alias("n")))


_IDS = "SELECT rpad(concat('id', CAST(user_id AS VARCHAR)), 43, 'x') AS blob_id, min(event_id) AS n FROM events WHERE {0} GROUP BY 1"


def _id_lines(t, where):
    line = F.rpad(F.concat(F.lit("id"), F.col("user_id").cast("string")), 43, "x")
    return t.events.where(where).select(line.alias("value"), F.col("event_id").alias("n"))


@query("src_id_list_active", f"SELECT * FROM ({_IDS.format("event_type = 'purchase'")}) ORDER BY n LIMIT 40")
def _(t):
    return L.preferred_ids(_id_lines(t, "event_type = 'purchase'"), _id_lines(t, "true"), 40)


@query("src_id_list_all", _IDS.format("TRUE"))
def _(t):
    # the list of active ids holds lines of the wrong length only
    return L.preferred_ids(_id_lines(t, "true").withColumn("value", F.lit("short")), _id_lines(t, "true"))


@query("decode_text")
def _(t):
    return t.v_payloads.select("blob_id", L.decode_text(F.unhex("h")).alias("text"))


@query("text_windows", "WITH n AS (SELECT doc_id, text, unnest(range(0, CAST(CASE WHEN length(text) <= 400 THEN 1 ELSE ceil((length(text) - 400) / 360.0) + 1 END AS BIGINT))) AS n FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(n AS INT) AS n, md5(substr(text, n * 360 + 1, 400)) AS piece FROM n")
def _(t):
    return R.text_windows(t.documents, "text", 400, 40, None).select("doc_id", "n", F.md5("piece").alias("piece"))


@query("prompt_expand", "SELECT p_partkey, t.i AS template, replace(t.f, '{}', p_brand) AS prompt FROM part, (VALUES (0, 'a photo of {}'), (1, 'a drawing of {}'), (2, '{} at night')) t(i, f)")
def _(t):
    # templates are three constants
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(("a photo of {}", "a drawing of {}", "{} at night"))])
    return t.part.select("p_partkey", "p_brand", F.explode(kinds).alias("t")).select("p_partkey", F.col("t.i").alias("template"), F.replace(F.col("t.f"), F.lit("{}"), F.col("p_brand")).alias("prompt"))


@query("join_images_annotations", "SELECT conv_id AS image_id, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(t):
    images = t.conversations.select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.col("conv_id").cast("string").alias("file_name"))
    ann = t.conversations.where("role = 'user'").select(F.col("turn").alias("id"), F.col("conv_id").alias("image_id"), F.col("text").alias("caption"))
    return L.caption_annotations(images, ann).select("image_id", F.size("captions").cast("long").alias("n"))


@query("src_payloads")
def _(t):
    # the table's own files as landed payloads
    found = L.payloads(t.spark, f"{t.dir}/documents.parquet").select("blob_id", "size", F.hex(F.substring("content", 1, 600)).alias("h"))
    return found.select("blob_id", "size", X.sniff(F.col("h"), F.col("size"))["kind"].alias("kind"))

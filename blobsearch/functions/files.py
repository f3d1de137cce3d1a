"""File types and names: kinds from bytes, mime types, extensions and tags, all inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extension families and the kinds they stand for; the extension of each mime type.
KIND_EXTENSIONS = {
    "audio": ("mp3", "wav", "wave", "flac", "ogg", "oga", "opus", "m4a", "m4b", "aac", "aif", "aiff", "wma", "amr"),
    "video": ("mp4", "m4v", "mov", "webm", "mkv", "avi", "flv", "wmv", "mpg", "mpeg"),
    "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "heic", "heif", "avif"),
    "doc": ("pdf", "doc", "docx", "rtf", "odt", "epub", "md", "mobi"),
    "text": ("txt", "json", "yaml", "yml", "xml", "html", "htm", "csv", "tsv", "log"),
    "archive": ("zip", "tar", "gz", "tgz", "rar", "7z", "bz2", "xz", "zst"),
    "code": ("py", "js", "ts", "rs", "go", "java", "cpp", "c", "h", "rb", "php", "sh"),
    "data": ("parquet", "arrow", "feather", "orc", "avro", "msgpack", "pb", "proto"),
}
EXTENSION_OF_MIME = {
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/bmp": "bmp",
    "image/tiff": "tiff",
    "image/tif": "tiff",
    "image/svg+xml": "svg",
    "image/x-icon": "ico",
    "image/vnd.microsoft.icon": "ico",
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/zip": "zip",
    "application/x-zip-compressed": "zip",
    "application/x-tar": "tar",
    "application/gzip": "gz",
    "application/x-gzip": "gz",
    "application/x-bzip2": "bz2",
    "application/x-7z-compressed": "7z",
    "application/x-rar-compressed": "rar",
    "application/x-walrus-quilt": "quilt",
    "video/mp4": "mp4",
    "video/webm": "webm",
    "video/quicktime": "mov",
    "video/x-msvideo": "avi",
    "video/x-matroska": "mkv",
    "audio/mpeg": "mp3",
    "audio/mp3": "mp3",
    "audio/wav": "wav",
    "audio/x-wav": "wav",
    "audio/ogg": "ogg",
    "audio/flac": "flac",
    "text/plain": "txt",
    "text/html": "html",
    "text/css": "css",
    "text/javascript": "js",
    "text/x-python": "py",
    "application/json": "json",
    "application/xml": "xml",
    "text/xml": "xml",
}
HEIC_BRANDS = ("heic", "heix", "heif", "mif1", "msf1")
AVIF_BRANDS = ("avif", "avis", "AVIF")
AUDIO_BRANDS = ("M4A ", "M4B ", "f4a ", "F4A ", "M4P ", "mp4a", "aac ")
#: Well-formed UTF-8 sequences of two to four bytes, or one, in hex.
_UTF8 = "[0-7].|(C[2-9A-F]|D.)[89AB].|E.([89AB].){2}|F[0-4]([89AB].){3}"
TAG_KEYS = ("content-type", "content_type", "Content-Type", "mime", "mimeType")


def kind_from_extension(ext: Column | str) -> Column:
    ext = F.col(ext) if isinstance(ext, str) else ext
    out = F.lit(None).cast("string")
    for kind, names in reversed(KIND_EXTENSIONS.items()):
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out


def extension_of(name: Column | str) -> Column:
    """Of the last path part, at most 8 letters or digits, lower case; '' if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"\.([A-Za-z0-9]{1,8})$", 1))


def kind_from_mime(mime: Column | str) -> Column:
    m = F.col(mime) if isinstance(mime, str) else mime
    out = F.lit("binary")
    rules = [
        (m == "application/x-walrus-quilt", "quilt"), *[(m.startswith(f"{k}/"), k) for k in ("image", "video", "audio", "text")],
        (m == "application/pdf", "pdf"), (m.isin("application/zip", "application/x-zip-compressed"), "archive"), (m.startswith("application/"), "application"),
    ]
    for when, kind in reversed(rules):
        out = F.when(when, kind).otherwise(out)
    return out


def extension_from_mime(mime: Column | str) -> Column:
    """The known extension; else a short plain subtype; else bin."""
    m = F.col(mime) if isinstance(mime, str) else mime
    sub = F.regexp_replace(F.regexp_replace(F.element_at(F.split(m, "/"), 2), r"x-|vnd\.", ""), r"\+(xml|json|zip)$", "")
    out = F.when((F.size(F.split(m, "/")) == 2) & sub.rlike("^[A-Za-z0-9]{1,5}$"), sub).otherwise("bin")
    known = F.create_map(*[F.lit(x) for pair in EXTENSION_OF_MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, m), out)


def kind_from_tags(tags: Column) -> Column:
    """The top-level type of the first content-type tag that names a known one."""
    out = F.lit(None).cast("string")
    for key in reversed(TAG_KEYS):
        top = F.lower(F.trim(F.substring_index(F.try_element_at(tags, F.lit(key)), "/", 1)))
        known = F.try_element_at(tags, F.lit(key)).contains("/") & top.isin("image", "audio", "video", "application", "text")
        out = F.when(known, top).otherwise(out)
    return out


def sniff(h: Column, size: Column) -> Column:
    """struct<mime_type, extension, kind> from the upper-case hex of a payload's prefix and its size in bytes; the first rule that holds."""
    # found from a byte's first digit on only
    has = lambda text, upto=None: (h if upto is None else F.substring(h, 1, 2 * upto)).rlike(f"^(?:..)*?{text.encode().hex().upper()}")
    at = lambda byte, n: F.substring(h, 2 * byte + 1, 2 * n)
    text = lambda s: s.encode().hex().upper()
    starts = lambda *hexes: _any(h.startswith(x) for x in hexes)
    later = F.regexp_extract(h, f"^(?:..){{4}}(?:..)*?{text('ftyp')}(.{{8}})", 1)
    brand = F.when(F.substring(h, 9, 8) == text("ftyp"), at(8, 4)).when(later != "", later)
    brand = F.when(brand.rlike("^([2-6][0-9A-F]|7[0-9A-E]){4}$"), brand)
    of = lambda *names: F.coalesce(brand.isin(*map(text, names)), F.lit(False))
    sound, picture = has("hdlr") & has("soun"), has("hdlr") & has("vide")
    head = F.substring(h, 1, 32)
    riff = h.startswith(text("RIFF"))
    m4a, mp4 = ("audio/mp4", "m4a", "audio"), ("video/mp4", "mp4", "video")
    rules = [
        (size == 0, ("application/octet-stream", "bin", "empty")),
        (starts(text("fLaC")), ("audio/flac", "flac", "audio")),
        (starts("FFF0", "FFF1", "FFF8", "FFF9"), ("audio/aac", "aac", "audio")),
        (starts(text("ID3"), "FFE", "FFF"), ("audio/mpeg", "mp3", "audio")),
        (starts(text("OggS")) & (has("theora", 512) | has("dirac", 512)), ("video/ogg", "ogv", "video")),
        (starts(text("OggS")), ("audio/ogg", "ogg", "audio")),
        (starts("1A45DFA3") & has("webm", 2048), ("video/webm", "webm", "video")),
        (starts("1A45DFA3"), ("video/x-matroska", "mkv", "video")),
        (riff & (at(8, 4) == text("WAVE")), ("audio/wav", "wav", "audio")),
        (riff & at(8, 4).isin(text("AVI "), text("QLCM"), text("AMV ")), ("video/x-msvideo", "avi", "video")),
        (riff & (at(8, 4) == text("WEBP")), ("image/webp", "webp", "image")),
        (starts("000001BA", "000001B3", "000001BB"), ("video/mpeg", "mpg", "video")),
        ((size >= 564) & (at(0, 1) == "47") & (at(188, 1) == "47") & (at(376, 1) == "47"), ("video/mp2t", "ts", "video")),
        (starts("464C5601"), ("video/x-flv", "flv", "video")),
        (of(*HEIC_BRANDS), ("image/heic", "heic", "image")),
        (of(*AVIF_BRANDS), ("image/avif", "avif", "image")),
        (of(*AUDIO_BRANDS), m4a),
        (of("M4V ", "M4VH", "M4VP", "avc1"), mp4),
        (brand.isNotNull() & sound & ~picture, m4a),
        (brand.isNotNull(), mp4),
        (starts(text("%PDF-")), ("application/pdf", "pdf", "pdf")),
        (starts("89504E470D0A1A0A"), ("image/png", "png", "image")),
        (starts("FFD8FF"), ("image/jpeg", "jpg", "image")),
        (starts(text("GIF87a"), text("GIF89a")), ("image/gif", "gif", "image")),
        (starts(text("BM")), ("image/bmp", "bmp", "image")),
        (starts("49492A00", "4D4D002A"), ("image/tiff", "tiff", "image")),
        (starts("377ABCAF271C"), ("application/x-7z-compressed", "7z", "archive")),
        (starts("1F8B"), ("application/gzip", "gz", "archive")),
        (starts("504B0304"), ("application/zip", "zip", "archive")),
        (~head.rlike("^(..)*00") & head.rlike(f"^({_UTF8})*$"), ("text/plain", "txt", "text")),
    ]
    first = F
    for i, (when, _) in enumerate(rules):
        first = first.when(when, i)
    values = [v for _, v in rules] + [("application/octet-stream", "bin", "binary")]
    names = ("mime_type", "extension", "kind")
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(v, names, strict=True)]) for v in values])
    return F.element_at(table, first.otherwise(len(rules)) + 1)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def audio_rescue(name: Column | str, kind: Column | str) -> Column:
    """audio for generic kinds whose name has an audio extension."""
    name, kind = (F.col(x) if isinstance(x, str) else x for x in (name, kind))
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(~kind.isin("audio", "image", "video") & name.contains(".") & ext.isin(*KIND_EXTENSIONS["audio"]), "audio").otherwise(kind)


def parent_of(composite: Column | str) -> Column:
    return F.substring_index(composite, "::", 1)


def identifier_of(composite: Column | str) -> Column:
    """What follows the first '::'; null without one."""
    c = F.col(composite) if isinstance(composite, str) else composite
    return F.when(c.contains("::"), F.regexp_replace(c, "(?s)^.*?::", ""))


def shard_filter(name: Column | str, mode: str) -> Column:
    """headers: no shard, or the first; first: the first shard only; all."""
    name = F.col(name) if isinstance(name, str) else name
    first = name.contains("_shard=0-")
    return {"headers": ~name.contains("_shard=") | first, "first": first, "all": F.lit(True)}[mode]


def caption_from_name(name: Column | str) -> Column:
    """A caption from a file name: without container, video extension and date-hash prefix; dashes and underscores as blanks."""
    c = F.col(name) if isinstance(name, str) else name
    c = F.coalesce(identifier_of(c), c)
    c = F.regexp_replace(c, r"(?i)\.(mp4|mov|webm|mkv)$", "")
    c = F.regexp_replace(c, r"^[0-9]{6,8}-[0-9]{4,6}-[0-9a-fA-F]{16,}-", "")
    return F.trim(F.regexp_replace(c, "[-_]+", " "))


@F.pandas_udf(T.BinaryType())
def _little_endian(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """256-bit decimal ids as 32 bytes, a digit of all ids at a time; null if it is no such number."""
    for s in ids:
        text = s.fillna("").str.replace(r"^0+(?=[0-9])", "", regex=True)
        ok = text.str.fullmatch("[0-9]{1,78}", flags=re.ASCII).to_numpy(bool)
        digits = np.frombuffer("".join(text.where(ok, "0").str.zfill(78)).encode(), np.uint8).reshape(len(s), 78).astype(np.uint64) - 48
        limbs = np.zeros((len(s), 17), np.uint64)  # 16 bits each; the last holds what exceeds 256
        for place in range(78):
            limbs *= np.uint64(10)
            limbs[:, 0] += digits[:, place]
            for i in range(16):
                limbs[:, i + 1] += limbs[:, i] >> np.uint64(16)
                limbs[:, i] &= np.uint64(0xFFFF)
        ok &= limbs[:, 16] == 0
        raw = limbs[:, :16].astype("<u2").tobytes()
        yield pd.Series([raw[32 * i : 32 * i + 32] if good else None for i, good in enumerate(ok)], dtype=object)


def u256_to_base64url(ids: Column | str) -> Column:
    """256-bit decimal ids as little-endian bytes in URL-safe Base64 without padding; null if it is no such number."""
    return F.rtrim(F.translate(F.base64(_little_endian(ids)), "+/=", "-_ "))

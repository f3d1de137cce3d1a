"""Registered queries. Stand-in tables are SQL that Spark and DuckDB both accept; a query and its oracle read the same ones."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

def _hex(text: str) -> str:
    return text.encode("latin-1").hex().upper()


#: Heads of payloads: marks of every known type, texts, and bytes that are neither.
HEADS = [
    "89504E470D0A1A0A", "FFD8FFE0", _hex("GIF89a"), _hex("%PDF-"), _hex("fLaC"), _hex("ID3"), "FFF1", "FFFB", _hex("OggS"), _hex("OggSxxtheora"),
    "1A45DFA3", "1A45DFA3" + _hex("webm"), _hex("RIFF0000WAVE"), _hex("RIFF0000WEBP"), _hex("RIFF0000AVI "), "000001BA", "464C5601",
    "0000001C" + _hex("ftypM4A "), "0000001C" + _hex("ftypheic"), "0000001C" + _hex("ftypavif"), "0000001C" + _hex("ftypisom"),
    "0000001C" + _hex("ftypisom__hdlr__soun"), "0000001C" + _hex("ftypisom__hdlr__vide"), _hex("BM"), "49492A00", "377ABCAF271C", "1F8B08", "504B0304",
    _hex("plain words here"), "C3A9C3A9", "00" * 16, "FFFE", "C328",
]

#: Stand-ins; a later one may read an earlier one.
VIEWS = {
    "v_blobs": """
        SELECT CAST(o_orderkey AS STRING) AS blob_id,
          CASE WHEN MOD(o_orderkey, 17) = 0 THEN NULL ELSE CAST(MOD(o_orderkey, 60) AS INT) END AS end_epoch,
          CAST(FLOOR(o_totalprice) AS BIGINT) AS size, CONCAT('0x', CAST(o_custkey AS STRING)) AS owner,
          CASE WHEN MOD(o_orderkey, 3) = 0 THEN 'graphql' ELSE 'listing' END AS source,
          CASE MOD(o_orderkey, 7) WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'video/mp4' WHEN 3 THEN 'audio/mpeg'
            WHEN 4 THEN 'text/plain' WHEN 5 THEN 'application/x-walrus-quilt' ELSE NULL END AS mime_type,
          CASE MOD(o_orderkey, 7) WHEN 0 THEN 'png' WHEN 1 THEN ' JPG ' WHEN 2 THEN 'mp4' WHEN 3 THEN 'mp3' WHEN 4 THEN '' WHEN 5 THEN 'quilt' ELSE NULL END AS extension,
          CASE MOD(o_orderkey, 7) WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' WHEN 4 THEN 'text' WHEN 5 THEN 'quilt' ELSE NULL END AS kind,
          MOD(o_orderkey, 5) <> 0 AS is_active,
          CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'discovered' ELSE 'fetch_failed' END AS status,
          o_orderstatus = 'F' AS indexed, MOD(o_orderkey, 11) = 0 AS is_nsfw, CAST(MOD(o_orderkey, 101) AS DOUBLE) AS nsfw_score,
          CASE WHEN o_orderstatus = 'F' THEN CAST(MOD(o_orderkey, 30) AS INT) ELSE NULL END AS cluster_id, o_orderdate AS first_seen_at
        FROM orders""",
    "v_batch": """
        SELECT CAST(o_orderkey AS STRING) AS blob_id, 0 AS seq,
          CASE WHEN MOD(o_orderkey, 4) = 0 THEN NULL ELSE CAST(MOD(o_orderkey, 60) + 7 AS INT) END AS end_epoch,
          CAST(MOD(o_orderkey, 5) * 1000 AS BIGINT) AS size, CASE WHEN MOD(o_orderkey, 3) = 0 THEN NULL ELSE 'new' END AS owner,
          CASE WHEN MOD(o_orderkey, 6) = 0 THEN NULL ELSE 'image' END AS kind, CASE WHEN MOD(o_orderkey, 8) = 0 THEN NULL ELSE 'image/webp' END AS mime_type,
          MOD(o_orderkey, 7) <> 0 AS is_active, 'seen' AS status, MOD(o_orderkey, 9) = 0 AS indexed
        FROM orders WHERE MOD(o_orderkey, 2) = 0
        UNION ALL
        SELECT CAST(o_orderkey AS STRING), 1, 99, CAST(0 AS BIGINT), NULL, 'video', NULL, TRUE, 'again', FALSE FROM orders WHERE MOD(o_orderkey, 10) = 0""",
    "v_old": "SELECT * FROM v_blobs WHERE MOD(CAST(blob_id AS BIGINT), 3) <> 0",
    "v_vectors": """
        SELECT CAST(vec_id AS STRING) AS blob_id, embedding, label, CASE WHEN MOD(vec_id, 4) = 3 THEN 'video' ELSE 'image' END AS kind,
          CASE WHEN MOD(vec_id, 3) = 0 THEN CONCAT('q', CAST(MOD(vec_id, 12) AS STRING)) ELSE NULL END AS parent_quilt_id,
          CAST(MOD(vec_id * 7919, 40000) AS BIGINT) AS size, MOD(vec_id, 13) = 0 AS is_nsfw,
          CASE WHEN MOD(vec_id, 9) = 0 THEN NULL ELSE CAST(MOD(vec_id, 60) AS INT) END AS expires_at
        FROM embeddings WHERE vec_id >= 20""",
    "v_queries": "SELECT CAST(vec_id AS STRING) AS query_id, embedding AS q, label AS truth FROM embeddings WHERE vec_id < 10",
    "v_prototypes": "SELECT CAST(vec_id AS STRING) AS proto_id, embedding AS p FROM embeddings WHERE vec_id BETWEEN 10 AND 17",
    "v_anchors": "SELECT CAST(vec_id AS STRING) AS anchor_id, embedding AS a, MOD(vec_id, 7) AS x FROM embeddings WHERE vec_id < 12",
    "v_captions": "SELECT CAST(doc_id AS STRING) AS blob_id, text AS caption, lang FROM documents",
    # changes of captions: deletions, two updates of some rows, texts that become null, and new rows
    "v_changes": """
        SELECT CAST(doc_id AS STRING) AS blob_id, 0 AS seq, MOD(doc_id, 10) = 3 AS deleted,
          CASE WHEN MOD(doc_id, 10) = 5 THEN CONCAT('renewed words in ', lang, ' ', text) WHEN MOD(doc_id, 10) = 3 THEN text ELSE NULL END AS caption
        FROM documents WHERE MOD(doc_id, 10) IN (3, 5, 7)
        UNION ALL
        SELECT CAST(doc_id AS STRING), 1, FALSE, CONCAT('last words of ', source) FROM documents WHERE MOD(doc_id, 20) = 5
        UNION ALL
        SELECT CONCAT('c', CAST(conv_id AS STRING)), 0, FALSE, MIN(text) FROM conversations GROUP BY conv_id""",
    "v_events": """
        SELECT event_id, ts, event_type AS type, CASE WHEN MOD(event_id, 10) = 0 THEN '' ELSE CAST(MOD(event_id, 4000) AS STRING) END AS blob_id,
          CAST(MOD(user_id, 12) AS STRING) AS upstream, value / 10.0 AS latency_secs, event_type <> 'error' AS ok
        FROM events""",
    "v_probes": """
        SELECT CAST(o_orderkey AS STRING) AS blob_id, 1 AS pass, CASE WHEN MOD(o_orderkey, 6) = 0 THEN 404 WHEN MOD(o_orderkey, 41) = 0 THEN -1 ELSE 200 END AS code FROM orders
        UNION ALL
        SELECT CAST(o_orderkey AS STRING), 2, CASE WHEN MOD(o_orderkey, 12) = 0 THEN 404 WHEN MOD(o_orderkey, 43) = 0 THEN -1 ELSE 200 END FROM orders""",
    "v_patches": """
        SELECT CONCAT('q', CAST(conv_id AS STRING)) AS quilt_id,
          CONCAT('dir.v1/file_', CAST(turn AS STRING), CASE MOD(conv_id + turn, 6) WHEN 0 THEN '.PNG' WHEN 1 THEN '.mp3' WHEN 2 THEN '.mp4' WHEN 3 THEN '.parquet' WHEN 4 THEN '' ELSE '_shard=1-4' END) AS identifier,
          CASE WHEN MOD(turn, 4) = 3 THEN 'audio/ogg' ELSE NULL END AS content_type
        FROM conversations""",
    "v_clips": "SELECT CAST(p_partkey AS STRING) AS blob_id, CAST(p_size AS DOUBLE) AS duration FROM part",
    # every vector is a segment of one of 97 videos; every document a true span of one, of its query
    "v_segments": "SELECT CAST(MOD(vec_id, 97) AS STRING) AS blob_id, CAST(FLOOR(vec_id / 97) AS DOUBLE) * 2 AS s, CAST(FLOOR(vec_id / 97) AS DOUBLE) * 2 + 4 AS e, embedding FROM embeddings",
    "v_truths": """
        SELECT CAST(MOD(doc_id, 97) AS STRING) AS blob_id, doc_id AS truth_id, CAST(MOD(doc_id, 10) AS STRING) AS query_id,
          CAST(MOD(doc_id * 13, 211) AS DOUBLE) / 2 AS g0, CAST(MOD(doc_id * 13, 211) AS DOUBLE) / 2 + 1 + MOD(doc_id, 9) + CASE WHEN MOD(doc_id, 50) = 0 THEN 60 ELSE 0 END AS g1
        FROM documents""",
    "v_labels": "SELECT CAST(doc_id AS STRING) AS blob_id, toxic = 1 AS is_nsfw_truth, quality FROM labels",
    "v_hashes": """
        SELECT CAST(vec_id AS STRING) AS blob_id, CAST(vec_id * 2654435761 AS BIGINT) AS h FROM embeddings
        UNION ALL
        SELECT CONCAT('dup', CAST(vec_id AS STRING)), CAST(vec_id * 2654435761 + MOD(vec_id, 3) AS BIGINT) FROM embeddings WHERE vec_id < 50""",
    # heads of payloads of every known type, told apart by key, as hex
    "v_payloads": f"""
        SELECT CAST(o_orderkey AS STRING) AS blob_id, CASE WHEN MOD(o_orderkey, {len(HEADS) + 1}) = {len(HEADS)} THEN ''
          ELSE CONCAT(CASE MOD(o_orderkey, {len(HEADS) + 1}) {' '.join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS))} END, REPLACE(REPLACE(CAST(o_orderkey + 10000000 AS STRING), '9', '4'), '8', '5')) END AS h
        FROM orders""",
    # listing items with both spellings of keys, blanks, zeros and unreadable epochs
    "v_items": """
        SELECT CAST(o_orderkey AS STRING) AS k, CAST(FLOOR(o_orderkey / 200) AS BIGINT) AS page,
          CASE MOD(o_orderkey, 3) WHEN 0 THEN CONCAT('{"blobIdBase64":"b', CAST(o_orderkey AS STRING), '","endEpoch":"', CAST(MOD(o_orderkey, 60) AS STRING), '","size":', CAST(MOD(o_orderkey, 4) * 10 AS STRING), ',"owner":""}')
            WHEN 1 THEN CONCAT('{"blobIdBase64":"","blob_id":"b', CAST(o_orderkey AS STRING), '","end_epoch":', CAST(MOD(o_orderkey, 60) AS STRING), ',"blob_size":7,"owner":"0x1","deletable":true}')
            ELSE CONCAT('{"blobId":"b', CAST(o_orderkey AS STRING), '","endEpoch":"soon","size":0,"timestamp":', CAST(o_orderkey AS STRING), '}') END AS item
        FROM orders""",
    # chain objects, nested with and without a wrapper, and metadata encoded once or twice
    "v_nodes": """
        SELECT CAST(o_orderkey AS STRING) AS k, CASE MOD(o_orderkey, 3)
            WHEN 0 THEN CONCAT('{"asMoveObject":{"contents":{"json":{"blob_id":"n', CAST(o_orderkey AS STRING), '","size":', CAST(MOD(o_orderkey, 9) AS STRING), ',"storage":{"end_epoch":', CAST(MOD(o_orderkey, 60) AS STRING), '}}}}}')
            WHEN 1 THEN CONCAT('{"asMoveObject":{"contents":{"json":{"blob_id":"n', CAST(o_orderkey AS STRING), '","storage":{"fields":{"end_epoch":', CAST(MOD(o_orderkey, 60) AS STRING), '}}}}}}')
            ELSE '{"asMoveObject":null}' END AS node, CONCAT('0x', CAST(MOD(o_custkey, 40) AS STRING)) AS owner,
          CASE MOD(o_orderkey, 4) WHEN 0 THEN CONCAT('{"size":', CAST(MOD(o_orderkey, 100) AS STRING), '}')
            WHEN 1 THEN CONCAT('"{', CHR(92), '"size', CHR(92), '":', CAST(MOD(o_orderkey, 100) AS STRING), '}"') WHEN 2 THEN '[1]' ELSE '{broken' END AS meta
        FROM orders""",
    "v_names": """
        SELECT CAST(o_orderkey AS STRING) AS k, CONCAT('Q', CAST(MOD(o_orderkey, 50) AS STRING), '::20240101-1200-', LPAD(CAST(o_orderkey AS STRING), 16, '0'), '-red_fox--runs', CAST(MOD(o_orderkey, 5) AS STRING),
          CASE MOD(o_orderkey, 6) WHEN 0 THEN '.MP4' WHEN 1 THEN '.opus' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' WHEN 4 THEN '.parquet' ELSE '.verylongext' END) AS name,
          CASE MOD(o_orderkey, 5) WHEN 0 THEN 'image/x-png' WHEN 1 THEN 'application/vnd.ms-excel' WHEN 2 THEN 'application/atom+xml' WHEN 3 THEN 'text/plain' ELSE 'odd' END AS mime
        FROM orders""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def needed(sql: str, own: tuple[str, ...] = ()) -> list[str]:
    """Stand-ins that a statement reads, each after those that it reads itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql) and name not in own:
            out += [x for x in needed(VIEWS[name], (*own, name)) if x not in out]
            out.append(name)
    return list(dict.fromkeys(out))


class Tables:
    """The tables of one directory, and stand-ins over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, statement: str) -> DataFrame:
        ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed(statement))
        text = f"WITH {ctes} {statement}" if ctes else statement
        frames = {t: getattr(self, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        text = text.replace("{", "{{").replace("}", "}}")  # braces of JSON texts are none of the statement's own
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text), **frames)


def query(key: str, sql: str | None = None):
    """Registers f(tables) under a key, with the oracle's DuckDB SQL over tables and stand-ins."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            views = needed(sql)
            ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
            body = sql.strip()
            if ctes and body.upper().startswith("WITH RECURSIVE "):
                body = f"WITH RECURSIVE {ctes}, {body[15:]}"
            elif ctes and body.upper().startswith("WITH "):
                body = f"WITH {ctes}, {body[5:]}"
            elif ctes:
                body = f"WITH {ctes} {body}"
            ORACLE[key] = body
        return f

    return add

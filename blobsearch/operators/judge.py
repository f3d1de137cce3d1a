"""Classification against anchors, duplicate provenance, and evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blobsearch.functions import hashing
from blobsearch.functions import vectors as V

from .components import components
from .search import ranked, small

# Label words of a vision model, in the order of their check, with scores.
LABEL_SCORES = (("EXPLICIT", 98.0), ("GORE", 92.0), ("SUGGESTIVE", 45.0), ("SAFE", 0.0))


def prototype_score(df: DataFrame, prototypes: DataFrame, multiplier: float, flag_above: float = 85.0) -> DataFrame:
    """blob_id, nsfw_score, flagged: the largest cosine to a prototype, scaled and capped."""
    s = df.crossJoin(small(prototypes)).groupBy("blob_id").agg(F.max(V.dot("embedding", "p")).alias("s"))
    score = F.least(F.greatest(F.col("s"), F.lit(0.0)) * multiplier, F.lit(100.0))
    return s.select("blob_id", score.alias("nsfw_score"), (score > flag_above).alias("flagged"))


def rescored(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose flag flips, or whose score was unknown or moves by over 1e-5."""
    n = new.select("blob_id", F.col("nsfw_score").alias("new_score"), F.col("flagged").alias("new_flag"))
    moved = F.col("nsfw_score").isNull() | (F.abs(F.col("new_score") - F.col("nsfw_score")) > 1e-5)
    return stored.join(n, "blob_id").where((F.coalesce("is_nsfw", F.lit(False)) != F.col("new_flag")) | moved).select("blob_id", "new_score", "new_flag")


def label_score(text: Column | str) -> Column:
    """Score of the first label word that an upper-cased answer holds; null without one."""
    t = F.upper(text)
    out = F.lit(None).cast("double")
    for word, score in reversed(LABEL_SCORES):
        out = F.when(t.contains(word), score).otherwise(out)
    return out


def nearest_anchors(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """blob_id with best and second-best anchor_id and similarity."""
    sims = df.crossJoin(small(anchors)).select("blob_id", "anchor_id", V.dot("embedding", "a").alias("s"))
    top = ranked(sims, F.col("blob_id"), [F.desc("s"), "anchor_id"], "r").where("r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return top.groupBy("blob_id").agg(pick("anchor_id", 1).alias("best"), pick("anchor_id", 2).alias("second"), pick("s", 1).alias("s1"), pick("s", 2).alias("s2"))


def tier(score: Column, margin: Column, high: float = 0.62, low: float = 0.56, least: float = 0.0, high_margin: float = 0.02, low_margin: float = 0.008) -> Column:
    return F.when((score >= max(least, high)) & (margin >= high_margin), "high").when((score >= max(least, low)) & (margin >= low_margin), "low").otherwise("uncertain")


def two_anchor_probability(a: Column, b: Column, temperature: float = 100.0) -> Column:
    """Softmax of two similarities."""
    return 1 / (1 + F.exp(temperature * (b - a)))


def dashboard(images: DataFrame, anchors: DataFrame, prototypes: DataFrame, nsfw: tuple[str, ...], multiplier: float = 300.0, semantic: float = 0.62, threshold: float = 0.0, high: float = 0.62, low: float = 0.56) -> DataFrame:
    """key, n: images of each category and confidence, by anchors (anchor_id, a) of which some are ``nsfw`` labels.

    An image is NSFW by its prototypes (the tag, high) or else by an NSFW anchor of
    at least ``semantic`` (low). Besides, its best other anchor counts as high or low
    if its score reaches ``threshold`` and that tier's, with the tier's margin over
    the second; all others are uncertain.
    """
    bad = F.col("anchor_id").isin(*nsfw)
    tag = prototype_score(images, prototypes, multiplier).select("blob_id", "flagged")
    sims = images.crossJoin(small(anchors.where(bad))).groupBy("blob_id").agg(F.max(F.round(V.dot("embedding", "a"), 9)).alias("sem"))
    best = nearest_anchors(images.select("blob_id", "embedding"), anchors.where(~bad))
    rows = best.join(tag, "blob_id").join(sims, "blob_id", "left")
    s1, margin = F.round("s1", 9), F.round(F.col("s1") - F.coalesce("s2", F.lit(-1.0)), 9)
    level = tier(s1, margin, high=max(threshold, high), low=max(threshold, low))
    name = F.col("best").cast("string")
    keys = F.when(level == "uncertain", F.array(F.lit("uncertain"))).otherwise(F.array(name, F.concat(name, F.lit(":"), level)))
    hit = F.when(F.col("flagged"), "high").when(F.col("sem") >= semantic, "low")
    both = F.concat(keys, F.when(hit.isNotNull(), F.array(F.lit("nsfw"), F.concat(F.lit("nsfw:"), hit))).otherwise(F.array().cast("array<string>")))
    return rows.select(F.explode(both).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def provenance(candidates: DataFrame, first: int = 12) -> DataFrame:
    """query_id, blob_id, class, n_exact, n_near: the first exact copy among the first candidates (rank, distance), else the first near one."""
    c = candidates.where(F.col("rank") <= first).withColumn("class", hashing.duplicate_class("distance"))
    dup = F.col("class").isin("exact_duplicate", "near_duplicate")
    order = F.struct((F.col("class") != "exact_duplicate").alias("x"), "rank")
    return c.groupBy("query_id").agg(
        F.min_by(F.when(dup, F.col("blob_id")), F.when(dup, order)).alias("blob_id"), F.min_by(F.when(dup, F.col("class")), F.when(dup, order)).alias("class"),
        F.count_if(F.col("class") == "exact_duplicate").alias("n_exact"), F.count_if(F.col("class") == "near_duplicate").alias("n_near"),
    )


def recall_at(hits: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """recall_k for each k from one row for each query with its first true rank (null: none found)."""
    return hits.agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks])


def first_true_rank(sims: DataFrame, true: Column) -> DataFrame:
    """query_id, first: the rank of each query's best true row in its similarity order; null without a true row.

    The best true row is one aggregate, the rows before it are counted by another: nothing is sorted.
    """
    rows = sims.select("query_id", F.struct((-F.col("sim")).alias("s"), "blob_id").alias("place"), true.alias("true"))
    best = rows.groupBy("query_id").agg(F.min(F.when(F.col("true"), F.col("place"))).alias("best"))
    before = rows.join(small(best), "query_id").groupBy("query_id", "best").agg(F.count_if(F.col("place") < F.col("best")).alias("n"))
    return before.select("query_id", F.when(F.col("best").isNotNull(), F.col("n") + 1).alias("first"))


def spans(segments: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """start and end of each segment on its key's time line."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(duration).over(w)
    return segments.withColumn("end", end).withColumn("start", F.col("end") - F.col(duration))


def duplicate_classes(hashes: DataFrame, most: int = hashing.NEAR) -> DataFrame:
    """blob_id, class_id (the smallest id that near links reach), copies (ids of its hash), links (other hashes within ``most`` bits of its own)."""
    reps = hashing.representatives(hashes)
    near = hashing.near_hashes(hashes, most)
    links = near.union(near.select("hb", "ha")).groupBy(F.col("ha").alias("h")).agg(F.count("*").alias("links"))
    found = components(near.toDF("a", "b"))
    # components are of hashes; their smallest id names them
    named = found.join(reps.select(F.col("h").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    of = found.join(named, "component").select(F.col("node").alias("h"), "class_id")
    each = reps.join(of, "h", "left").join(links, "h", "left").select("h", F.coalesce("class_id", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return hashes.where("h is not null").select("blob_id", "h").distinct().join(each, "h").select("blob_id", "class_id", "copies", "links")


def duplicate_accuracy(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    """exact, near: shares of pairs (blob_id, copy) told as such; false_positive: of blobs whose best other candidate, neither itself nor its copy, is told as a duplicate."""
    h = hashes.where("h is not null").select("blob_id", "h")
    both = pairs.join(h, "blob_id").join(h.select(F.col("blob_id").alias("copy"), F.col("h").alias("g")), "copy", "left")
    reps = hashing.representatives(hashes).select("h", "copies")
    near = hashing.near_hashes(hashes)
    around = near.union(near.select("hb", "ha")).toDF("h", "k").join(reps.select(F.col("h").alias("k"), "copies"), "k").groupBy("h").agg(F.sum("copies").alias("around"))
    # ids within reach of a blob's hash, without itself and its copy
    rows = both.join(reps, "h").join(around, "h", "left").withColumn("d", hashing.hamming("h", "g"))
    others = F.col("copies") + F.coalesce("around", F.lit(0)) - 1 - F.when(F.col("d") <= hashing.NEAR, 1).otherwise(0)
    kind = hashing.duplicate_class("d")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    told = F.col("d").isNotNull()
    return rows.agg(
        F.round(F.avg(F.when(told, F.when(kind == "exact_duplicate", 1.0).otherwise(0.0))), 6).alias("exact"),
        F.round(F.avg(F.when(told, F.when(kind == "near_duplicate", 1.0).otherwise(0.0))), 6).alias("near"), share(others > 0).alias("false_positive"),
    )

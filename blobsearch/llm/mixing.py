"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources by weight.
No node takes more than its leaves can give in the allowed epochs; what one
child cannot take goes to its siblings, and only what all of them cannot take
stays with the parent's siblings. A leaf then takes whole epochs and a prefix
of one more: its documents in a seeded order, as long as their tokens fit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import settle, table, told

LEVELS = ("domain", "lang", "source")
#: The prefix is found by the order key's next bits, round by round, and sorted only in the last bucket.
BITS, ROUNDS, KEY_BITS = 8, 3, 63

#: The mixture of the registered query: share of the corpus's tokens, most epochs, weights by level.
BUDGET_SHARE, EPOCHS, SEED = 0.5, 2, 17
WEIGHTS = {"domain": {"d0": 0.5, "d1": 0.3, "d2": 0.2}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}


def allocate(supply: DataFrame, budget: float, weights: Mapping[str, Mapping[str, float]], epochs: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Adds taken, whole tokens, to leaves (the levels, n). A label without a weight weighs 1, one of weight 0 takes nothing.

    Level by level each node divides its amount among its children by weight; a
    child with less room than its share takes its room, and the others divide the
    rest. Children stand by room over weight: those before the first that its
    share does not fill are full, and it tells the share of a weight of all others.
    """
    at, tree = [], {}
    for depth in range(len(levels), 0, -1):
        path = list(levels[:depth])
        tree[depth] = supply.groupBy(*path).agg((F.sum("n") * epochs).cast("double").alias("room"))
    amount = supply.agg(F.least(F.lit(float(budget)), F.sum("n") * epochs).cast("double").alias("amount"))
    for depth in range(1, len(levels) + 1):
        name = levels[depth - 1]
        told_weights = [x for pair in weights.get(name, {}).items() for x in (F.lit(pair[0]), F.lit(float(pair[1])))]
        weight = F.coalesce(F.try_element_at(F.create_map(*told_weights), F.col(name)), F.lit(1.0)) if told_weights else F.lit(1.0)
        nodes = tree[depth].withColumn("w", weight)
        nodes = nodes.join(amount, at) if at else nodes.crossJoin(amount)
        family = Window.partitionBy(*at) if at else Window.partitionBy(F.lit(0))  # the top level: domains
        order = family.orderBy(F.try_divide("room", "w").asc(), name)
        open_ = F.col("w") > 0
        before = F.coalesce(F.sum(F.when(open_, F.col("room"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum(F.when(open_, F.col("w")).otherwise(0.0)).over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("share", F.when(open_, F.try_divide(F.col("amount") - before, left)))
        nodes = nodes.withColumn("full", open_ & (F.col("share") * F.col("w") >= F.col("room")))
        # shares of those not full: all as of the first of them
        nodes = nodes.withColumn("rate", F.max(F.when(~F.col("full") & open_, F.struct((-F.try_divide("room", "w")).alias("late"), "share"))).over(family)["share"])
        given = F.when(~open_, 0.0).when(F.col("full"), F.col("room")).otherwise(F.greatest(F.lit(0.0), F.col("rate") * F.col("w")))
        at = list(levels[:depth])
        amount = nodes.select(*at, given.alias("amount"))
    return supply.join(amount, at).select(*at, "n", F.floor(F.col("amount") + 1e-6).alias("taken"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _leaf(levels: Sequence[str]) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]


def placement(narrow: DataFrame, weights: Mapping[str, Mapping[str, float]], budget_share: float, epochs: int, seed: int, levels: Sequence[str]) -> DataFrame:
    """A row for each leaf: the levels, epochs (whole ones), rest (tokens of one more), low and end, where its prefix ends in the order of keys.

    narrow: doc_id, the levels, n_tokens, settled.
    """
    names = list(levels)
    supply = settle(narrow.groupBy(*names).agg(F.sum("n_tokens").alias("n")), "supply")
    total = supply.agg(F.sum("n")).first()[0] or 0
    taken = allocate(supply, budget_share * total, weights, epochs, levels)
    whole = F.when(F.col("n") > 0, F.floor(F.col("taken") / F.col("n"))).otherwise(0).cast("long")
    leaf = F.xxhash64(*names, F.lit("leaf")).alias("leaf")
    plan = settle(taken.select(*names, leaf, whole.alias("epochs"), F.when(F.col("n") > 0, F.col("taken") - whole * F.col("n")).otherwise(0).cast("long").alias("rest")), "plan")

    # the order of the epoch of which a prefix is taken
    ordered = narrow.join(told(plan), names).withColumn("key", _key(seed))
    cut = plan.select("leaf", F.lit(0).cast("long").alias("low"), "rest")
    for k in range(1, ROUNDS + 1):
        width = KEY_BITS - BITS * k  # a bucket's keys share all but these bits
        inside = ordered.drop("rest").join(told(cut), "leaf").where((F.col("key") >= F.col("low")) & (F.shiftright("key", width + BITS) == F.shiftright("low", width + BITS)))
        sums = inside.groupBy("leaf", "rest", F.shiftleft(F.shiftright("key", width), width).alias("low")).agg(F.sum("n_tokens").alias("n"))
        w = Window.partitionBy("leaf").orderBy("low")
        upto = sums.withColumn("upto", F.sum("n").over(w)).withColumn("last", F.max("low").over(Window.partitionBy("leaf")))
        # the first bucket that does not fit whole; if all fit, the last one
        cut = upto.where((F.col("upto") > F.col("rest")) | (F.col("low") == F.col("last"))).groupBy("leaf").agg(F.min_by(F.struct("low", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), "low").alias("c")).select("leaf", "c.low", "c.rest")
        cut = settle(cut, "cut")
    inside = ordered.drop("rest").join(told(cut), "leaf").where(F.shiftright("key", width) == F.shiftright("low", width))
    units = inside.groupBy("leaf", "rest", "key", _id().alias("id")).agg(F.sum("n_tokens").alias("n"))
    fits = units.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("key", "id"))).where("upto <= rest")
    end = cut.select("leaf", "low").join(fits.groupBy("leaf").agg(F.max(F.struct("key", "id")).alias("end")), "leaf", "left")
    return settle(plan.join(end, "leaf").select(*names, "epochs", "rest", "low", "end"), "ends")


def _key(seed: int):
    return F.xxhash64(F.lit(seed), "epochs", "doc_id").bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def _id():
    return F.coalesce("doc_id", F.lit(-1 << 63))


def place(rows: DataFrame, ends: DataFrame, seed: int, levels: Sequence[str]) -> DataFrame:
    """Adds copies to rows (doc_id, the levels, ...) of a ``placement``; those that it does not take go."""
    placed = rows.join(told(ends), list(levels)).withColumn("key", _key(seed))
    # (key, id) up to the end are in the prefix; without a fitting document of the cut bucket, keys below it
    here = F.struct(F.col("key"), _id().alias("id"))
    inside = F.when(F.col("end").isNotNull(), here <= F.col("end")).otherwise(F.col("key") < F.col("low"))
    # a leaf that takes a whole number of epochs takes no more, not even empty documents
    more = F.when((F.col("rest") > 0) & inside, 1).otherwise(0)
    return placed.withColumn("copies", F.col("epochs") + more).where("copies > 0").drop("epochs", "rest", "low", "end", "key")


def _narrow(docs: DataFrame, levels: Sequence[str]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_leaf(levels), word_count(F.col("text").cast("string")).alias("n_tokens"))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, float]], budget_share: float, epochs: int = 1, seed: int = 0, levels: Sequence[str] = LEVELS) -> DataFrame:
    """doc_id, the levels, n_tokens, copies: the documents that the mixture takes, with how many epochs take each.

    ``docs``: doc_id, text and the level columns; a null label is the label ''.
    budget_share: of the corpus's words. Rows that repeat a doc_id in a leaf stand
    and fall together; a null doc_id is one like any other. Documents without
    words take no budget and go with their place in the order. An empty table
    gives an empty result.
    """
    narrow = settle(_narrow(docs, levels), "tokens")
    ends = placement(narrow, weights, budget_share, epochs, seed, levels)
    return place(narrow, ends, seed, levels).select("doc_id", *levels, "n_tokens", "copies")


def with_domain(docs: DataFrame) -> DataFrame:
    """Adds the domain of a source: its number modulo 3, other sources are d0. A domain that is there already is replaced."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(cast(source AS string), '([0-9]+)$', 1) AS bigint)"), F.lit(0))
    return docs.withColumn("domain", F.concat(F.lit("d"), F.pmod(number, F.lit(3)).cast("string")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), WEIGHTS, BUDGET_SHARE, EPOCHS, SEED)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mixture, with their domain, n_tokens and copies.

    Each row is placed where it stands: a null doc_id is one like any other, and
    rows that repeat a doc_id in a leaf stand and fall together. Columns of the
    input named domain, n_tokens or copies are replaced; all others are kept.
    """
    new = ["domain", "n_tokens", "copies"]
    kept = [c for c in docs.columns if c not in new]
    narrow = _narrow(with_domain(docs.select("doc_id", "text", "lang", "source")), LEVELS)
    ends = placement(settle(narrow, "tokens"), WEIGHTS, BUDGET_SHARE, EPOCHS, SEED, LEVELS)
    # the row itself travels as one column, so that its names meet no others
    rows = with_domain(docs.select(F.struct(*kept).alias("row"), "doc_id", "text", "lang", "source"))
    rows = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), *_leaf(LEVELS), word_count(F.col("text").cast("string")).alias("n_tokens"))
    return place(rows, ends, SEED, LEVELS).select(*[F.col("row")[c].alias(c) for c in kept], *new)

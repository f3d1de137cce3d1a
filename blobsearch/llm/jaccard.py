"""N-gram Jaccard join with PartEnum signatures.

Documents are sets of distinct 5-word shingles. Sizes fall into bands such that
linked sets (Jaccard 0.75 or more) lie in one band or in neighbouring ones; a
set signs once for its own band and once for the next. In each of these
instances the shingle domain is cut by hash into groups, each group into PARTS
parts, and every subset of PARTS - SPOILT parts of a group is a signature: the
content of these parts. Linked sets differ in at most k shingles, so in some
group at most SPOILT parts differ and the others, as one of the subsets, agree.

Signatures of few shingles say little. To spoil all signatures of a group that
hold more than t shingles, differences have to touch a part of each; the least
numbers of parts that do so, summed over groups, have to exceed k. A set leaves
out its signatures of up to t shingles, with the largest t for which that still
holds. Of two linked sets the one with the larger t then shares one of the
signatures that it keeps, which the other keeps too: no linked pair is lost.

Before, a packed count of shingles takes out sets of which less than three
quarters stand in another set: those are linked with nothing. Sets that
signatures connect form groups; only inside them sets are compared exactly,
in blocks, and a block returns a spanning forest of its links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .store import Scratch, documents_of, partitions, small_batches, table, told, with_row_key

SHINGLE = 5
#: Parts of a first-level group; parts of it that may differ (a signature holds the others); differences for each group, on average.
PARTS, SPOILT, DIFFERENCES = 4, 2, 2.5
#: Largest t.
SMALL = 6
#: Shingles that a task holds before it packs them, and of a batch of sets that sign.
HELD, SIGNED = 500_000, 125_000
#: Rows that are cut into segments at a time.
ROWS = 16_384
#: Entries of runs that a task connects at a time.
FLUSH = 250_000
#: Sets and shingles of a block, on average.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Sets of a block that hold a shingle, from which it is counted by matrix product; columns of one product.
DENSE, COLUMNS = 24, 4096
#: Owner of a packed shingle that several sets of its unit hold.
SEVERAL = 0xFFFF


def _bands() -> np.ndarray:
    """Largest size of each band."""
    tops, low = [], 1
    while low < 1 << 40:
        tops.append(low * 4 // 3)
        low = tops[-1] + 1
    return np.array(tops)


TOPS = _bands()
#: First-level groups of each instance: at most SPOILT differences in one of them.
GROUPS = np.where(2 * TOPS // 7 <= SPOILT, 1, np.floor(2 * TOPS // 7 / DIFFERENCES).astype(np.int64) + 1)
SUBSETS = list(itertools.combinations(range(PARTS), PARTS - SPOILT))


def _spoiling() -> np.ndarray:
    """For each choice of subsets (as bits) the fewest parts that meet all of them."""
    out = np.zeros(1 << len(SUBSETS), np.int64)
    for bits in range(1, len(out)):
        chosen = [set(s) for i, s in enumerate(SUBSETS) if bits >> i & 1]
        out[bits] = next(n for n in range(1, PARTS + 1) if any(all(s & set(hit) for s in chosen) for hit in itertools.combinations(range(PARTS), n)))
    return out


COST = _spoiling()


def shingle_sets(s: textnum.Segment, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle, sorted; a text of fewer than k words is one shingle."""
    h = s.word_hashes()
    rows = textnum.gram_rows(s, k)
    doc, value = [s.doc[rows]], [textnum.grams(h, k)[rows]]
    for n in range(1, k):
        short = np.flatnonzero(s.words == n)
        if len(short):
            doc.append(short)
            value.append(textnum.mix(textnum.grams(h, n)[s.begin[short]] + np.uint64(n)))
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _class_of(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set, and a hash of the whole set."""
    size = np.bincount(doc, minlength=n)
    total = np.zeros(n, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        total[some] = np.add.reduceat(textnum.mix(value + np.uint64(0x51ED270B)), (np.cumsum(size) - size)[some])
    return size, textnum.mix(total + size.astype(np.uint64))


def _segments(b: pa.RecordBatch) -> Iterator[textnum.Segment]:
    return textnum.segments(b["text"], textnum.SPACE, lower=True, limit=textnum.SMALL_BYTES)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for x in keys:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def _sizes(head: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(head, n))


# --- sets that share enough of their shingles --------------------------------

_UNIT = pa.schema([
    ("bucket", pa.int32()), ("unit", pa.int64()), ("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()),
    ("cls", pa.int64()), ("owner", pa.int32()), ("shared", pa.int64()), ("owners", pa.binary()), ("data", pa.binary()),
])
_UNIT_SQL = "bucket int, unit long, row_key long, doc_id long, n long, cls long, owner int, shared long, owners binary, data binary"
_PROFILE = ["row_key", "doc_id", "n", "cls", "shared"]


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """Rows of _UNIT; columns not named are null."""

    def column(f: pa.Field) -> pa.Array:
        c = columns.get(f.name)
        return pa.nulls(rows, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type)

    return pa.record_batch([column(f) for f in _UNIT], schema=_UNIT)


def _packed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Units of documents: a row for each document, and for each bucket the unit's distinct shingles there, each with its only owner or SEVERAL.

    A unit's owners are its distinct sets. ``shared`` counts the shingles of a set that others of its unit hold.
    """
    unit = TaskContext.get().partitionId() << 32
    owners: dict[int, int] = {}
    rows, value, owner = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, o = np.concatenate(value), np.concatenate(owner)
        del value[1:], owner[1:]  # what is held is not kept beside its copy
        # buckets by the upper half of a hash, in its place; inside a bucket the lower half tells shingles apart
        half = key.view("<u4")[1::2]
        half %= np.uint32(buckets)
        order = np.argsort(key, kind="stable")
        key, o = key[order], o[order]
        del order, half
        head = _heads(key)
        size = _sizes(head, len(key))
        shared = np.append(np.bincount(o[np.repeat(size > 1, size)], minlength=len(owners)), 0)
        ids = pa.concat_arrays([x[1] for x in rows])
        row_key, size_of, cls, own = (np.concatenate([x[i] for x in rows]) for i in (0, 2, 3, 4))
        yield _batch(len(own), bucket=np.arange(len(own)) % buckets, unit=np.full(len(own), unit), row_key=row_key, doc_id=ids, n=size_of, cls=cls, owner=own, shared=shared[own])
        key, o = key[head], np.where(size > 1, SEVERAL, o[head]).astype("<u2")
        bucket, low = (key >> np.uint64(32)).astype(np.int64), key.astype("<u4")
        at = _heads(bucket)
        pieces = list(itertools.pairwise(np.append(at, len(low)).tolist()))
        yield _batch(len(at), bucket=bucket[at], unit=np.full(len(at), unit), owners=[o[x:y].tobytes() for x, y in pieces], data=[low[x:y].tobytes() for x, y in pieces])

    for b in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
        for s in _segments(b):
            if n >= HELD or len(owners) + s.n >= SEVERAL:
                yield from flush()
                unit, owners, n = unit + 1, {}, 0
                rows, value, owner = [], value[:1], owner[:1]
            doc, v = shingle_sets(s)
            size, cls = _class_of(doc, v, s.n)
            own, fresh = np.full(s.n, -1), np.zeros(s.n, bool)
            for i in np.flatnonzero(size).tolist():
                known = len(owners)
                own[i] = owners.setdefault(int(cls[i]), known)
                fresh[i] = own[i] == known
            live = fresh[doc]
            rows.append((b["row_key"].slice(s.first, s.n).to_numpy(), b["doc_id"].slice(s.first, s.n), size, cls.view(np.int64), own))
            value.append(v[live])
            owner.append(own[doc[live]].astype(np.uint16))
            n += len(value[-1])
    if rows:
        yield from flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket's rows to counts, for each unit and owner, of shingles that other units hold; rows of documents pass."""
    unit, owners, low = [], [], []
    for b in batches:
        packed = b["data"].is_valid()
        yield b.filter(b["data"].is_null())
        b = b.filter(packed)
        unit += b["unit"].to_pylist()
        owners += [np.frombuffer(x.as_buffer(), "<u2") for x in b["owners"]]
        low += [np.frombuffer(x.as_buffer(), "<u4") for x in b["data"]]
    if not low:
        return
    row, low, owner = np.repeat(np.arange(len(low)), [len(x) for x in low]), np.concatenate(low), np.concatenate(owners)
    order = np.argsort(low, kind="stable")
    same = low[order[1:]] == low[order[:-1]]
    again = np.zeros(len(low), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again &= owner != SEVERAL
    key, times = np.unique(row[again] * (SEVERAL + 1) + owner[again], return_counts=True)
    row, owner = key // (SEVERAL + 1), (key % (SEVERAL + 1)).astype("<u2")
    at = _heads(row)
    pieces = list(itertools.pairwise(np.append(at, len(row)).tolist()))
    times = times.astype("<u4")
    yield _batch(len(at), unit=[unit[r] for r in row[at]], owners=[owner[x:y].tobytes() for x, y in pieces], data=[times[x:y].tobytes() for x, y in pieces])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit to the documents of each unit with their full ``shared``."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        docs, counts = t.filter(t["data"].is_null()), t.filter(t["data"].is_valid())
        owner = docs["owner"].to_numpy()
        more = np.zeros(max(owner.max(initial=-1), 0) + 2, np.int64)
        for o, n in zip(counts["owners"], counts["data"], strict=True):
            more[np.frombuffer(o.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<u4")
        shared = docs["shared"].to_numpy() + more[owner]  # owner -1, of an empty set, meets the last place
        yield from docs.set_column(docs.schema.get_field_index("shared"), "shared", pa.array(shared)).select(_PROFILE).to_batches()

    for b in batches:
        unit = b["unit"].to_numpy()
        for x, y in itertools.pairwise(np.append(_heads(unit), len(unit)).tolist()):
            if held and held[-1]["unit"][0].as_py() != unit[x]:
                yield from whole()
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield from whole()


def profile(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n, cls, shared: for each row its set's size and hash, and at least so many of its shingles as another set, or a copy in another task, holds."""
    n = partitions(docs.sparkSession)
    packed = docs.mapInArrow(lambda b: _packed(b, n), _UNIT_SQL)
    counted = packed.repartitionById(n, "bucket").mapInArrow(_counted, _UNIT_SQL)
    return counted.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(_profiles, "row_key long, doc_id long, n long, cls long, shared long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, n, shingles (the sorted hashes) of documents chosen for their class; each once in a task."""
    seen: set[int] = set()
    for b in batches:
        for s in _segments(b):
            doc, value = shingle_sets(s)
            size, cls = _class_of(doc, value, s.n)
            want = b["cls"].slice(s.first, s.n).to_numpy()
            cuts = np.searchsorted(doc, np.arange(s.n + 1))
            # a repeated doc_id may stand for another text, and a repeated row for the same
            rows = [i for i in np.flatnonzero(cls.view(np.int64) == want).tolist() if not (int(cls[i]) in seen or seen.add(int(cls[i])))]
            yield pa.record_batch([pa.array(want[rows]), pa.array(size[rows]), pa.array([value[cuts[i] : cuts[i + 1]].tobytes() for i in rows], pa.binary())], ["cls", "n", "shingles"])


# --- signatures --------------------------------------------------------------


def signatures(value: np.ndarray, size: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """sig, cls of sets given by their shingles, one set after the other: subsets of the parts of each group, in two instances."""
    doc = np.repeat(np.arange(len(size)), size)
    for up in (0, 1):
        instance = np.searchsorted(TOPS, size) + up
        groups = GROUPS[instance]
        most = (size + np.minimum(TOPS[instance], size * 4 // 3)) // 7  # differences from a linked set of this instance
        seed = textnum.mix(instance.astype(np.uint64) + np.uint64(77))
        h = textnum.mix(value ^ seed[doc])
        first = np.cumsum(groups) - groups
        group = first[doc] + ((h >> np.uint64(20)) % groups[doc].astype(np.uint64)).astype(np.int64)
        cell = group * PARTS + ((h >> np.uint64(7)) % np.uint64(PARTS)).astype(np.int64)
        n_cells = int(groups.sum()) * PARTS
        content = np.zeros(n_cells, np.uint64)
        np.add.at(content, cell, textnum.mix(h + np.uint64(5)))
        content, held = content.reshape(-1, PARTS), np.bincount(cell, minlength=n_cells).reshape(-1, PARTS)
        owner = np.repeat(np.arange(len(size)), groups)
        number = (np.arange(len(owner)) - first[owner]).astype(np.uint64)
        filled = np.stack([held[:, s].sum(1) for s in SUBSETS], 1)
        small = np.full(len(size), -1)  # -1 keeps signatures of empty parts too, which suffices by counting
        for t in range(SMALL + 1):
            bits = ((filled > t) << np.arange(len(SUBSETS))).sum(1)
            small[np.bincount(owner, weights=COST[bits], minlength=len(size)) > most] = t
        for i, s in enumerate(SUBSETS):
            keep = filled[:, i] > small[owner]
            who, inside = owner[keep], content[keep][:, s].sum(1, dtype=np.uint64)
            yield textnum.mix(textnum.mix(inside + np.uint64(i + 1)) + seed[who] * np.uint64(3) + number[keep] * np.uint64(0x9E3779B97F4A7C15)), cls[who]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, cls = b["n"].to_numpy(), b["cls"].to_numpy()
        at = 0
        while at < len(size):
            upto = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), SIGNED)))
            value = np.frombuffer(b"".join(x.as_buffer() for x in b["shingles"].slice(at, upto - at)), np.uint64)
            for sig, who in signatures(value, size[at:upto], cls[at:upto]):
                yield pa.record_batch([pa.array(sig.view(np.int64)), pa.array(who)], ["sig", "cls"])
            at = upto


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Rows centre, member (centre < member) that connect what all of them do: one less than there are sets, at most. Each member keeps its smallest centre."""
    ids, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(-1, 2)
    root, kept = np.arange(len(ids)), np.zeros(len(pairs), bool)
    while True:
        x, y = root[place[:, 0]], root[place[:, 1]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        live = np.flatnonzero(low != high)
        if not len(live):
            return pairs[kept]
        # roots hang on smaller ones, so that no cycle closes
        order = live[np.lexsort((low[live], high[live]))]
        order = order[_heads(high[order])]
        kept[order] = True
        to = np.arange(len(ids))
        to[high[order]] = low[order]
        while (to[to] != to).any():
            to = to[to]
        root = to[root]


def _stars(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sig, cls to pairs of a run's smallest member (centre) and another one that connect what runs connect, packed by part of the centre. FLUSH rows give fewer pairs than sets, however many signatures these share."""
    sig, cls, n = [], [], 0

    def flush() -> pa.RecordBatch:
        head = _heads(sig[0])
        centre = np.repeat(cls[0][head], _sizes(head, len(sig[0])))
        live = centre != cls[0]
        centre, member = centre[live], cls[0][live]
        pairs = spanning(np.stack([centre, member], 1))
        part = (textnum.mix(pairs[:, 0].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        pairs, part = pairs[order], part[order]
        at = _heads(part)
        pieces = itertools.pairwise(np.append(at, len(part)).tolist())
        return pa.record_batch([pa.array(part[at]), pa.array([pairs[x:y].tobytes() for x, y in pieces], pa.binary())], ["part", "pairs"])

    for b in batches:
        sig.append(b["sig"].to_numpy())
        cls.append(b["cls"].to_numpy())
        n += len(b)
        if n >= FLUSH:
            sig, cls = [np.concatenate(sig)], [np.concatenate(cls)]
            yield flush()
            last = np.searchsorted(sig[0], sig[0][-1])  # the last run may go on: its centre stays
            sig, cls, n = [sig[0][last : last + 1]], [cls[0][last : last + 1]], 1
    if n:
        sig, cls = [np.concatenate(sig)], [np.concatenate(cls)]
        yield flush()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one part, as centre, cls, that connect what all of them do."""
    held = [np.frombuffer(x.as_buffer(), np.int64) for b in batches for x in b["pairs"]]
    if held:
        pairs = spanning(np.concatenate(held).reshape(-1, 2))
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["centre", "cls"])


# --- exact comparison --------------------------------------------------------


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, above the diagonal."""
    m = len(sets)
    value, member = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, member = value[order], member[order]
    head = _heads(value)
    size = _sizes(head, len(value))
    out = np.zeros((m, m), np.int64)
    for d in np.unique(size[(size > 1) & (size < DENSE)]).tolist():
        held = member[head[size == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        out += np.bincount((held[:, i] * m + held[:, j]).ravel(), minlength=m * m).reshape(m, m)
    often = np.flatnonzero(size >= DENSE)
    for at in range(0, len(often), COLUMNS):
        part = often[at : at + COLUMNS]
        x = np.zeros((m, len(part)), np.float32)
        x[member[np.repeat(head[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())], np.repeat(np.arange(len(part)), size[part])] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return np.triu(out, 1)


def forest(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first that links (100 * intersection >= 75 * union) reach from it."""
    n = np.array([len(x) for x in sets])
    link = 7 * overlaps(sets) >= 3 * (n[:, None] + n[None, :])
    link = np.triu(link, 1)
    link |= link.T
    label = np.arange(len(n))
    while True:
        least = np.minimum(label, np.where(link, label[None, :], len(n)).min(1, initial=len(n)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to a, b: a spanning forest of the links inside each block."""
    block, cls, sets = None, [], []

    def done() -> pa.RecordBatch:
        who = np.array(cls)
        to = who[forest(sets)]
        return pa.record_batch([pa.array(who[who != to]), pa.array(to[who != to])], ["a", "b"])

    for b in batches:
        for at, c, data in zip(b["block"].to_pylist(), b["cls"].to_pylist(), b["shingles"], strict=True):
            if at != block:
                if len(cls) > 1:
                    yield done()
                block, cls, sets = at, [], []
            cls.append(c)
            sets.append(np.frombuffer(data.as_buffer(), np.uint64))
    if len(cls) > 1:
        yield done()


def compare(places: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links of sets that stand in one block; places: cls, block."""
    n = partitions(sets.sparkSession)
    rows = places.join(sets, "cls").select("block", "cls", "shingles")
    return rows.repartition(n, "block").sortWithinPartitions("block", "cls").mapInArrow(_blocks, "a long, b long")


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """node, label: the smallest node that edges (a, b) reach.

    In each round every node hooks to its smallest neighbour, and once to that
    one's, and edges are told between what nodes hooked to: edges inside a group
    that came together go, so later rounds join few.
    """
    links = work.settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("x", "y")
        near = work.settle(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")), "near")
        up = near.toDF("to", "up")
        hooks = work.settle(near.join(up, "to").select("x", "up"), "hooks")
        first = hooks.toDF("a", "a2")
        links = links.join(first, "a").join(hooks.toDF("b", "b2"), "b").where("a2 <> b2")
        links = work.settle(links.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        if labels is None:
            labels = hooks.toDF("node", "label")
        else:
            # nodes whose label met no further edge stay
            moved = labels.join(hooks.toDF("label", "further"), "label", "left")
            labels = work.settle(moved.select("node", F.coalesce("further", "label").alias("label")), "labels")
    return labels


def _cut(m, n):
    """Blocks for m sets of n shingles."""
    return F.greatest(F.ceil(m / BLOCK), F.ceil(n / BLOCK_SHINGLES))


def _block_pairs(members: DataFrame, stars: DataFrame, sets: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """cls, block of groups of several blocks, and links a, b found on the way.

    Sets are first compared with the smallest one that shares a signature with
    them. What that connects stands in blocks of its own where it fills them, and
    two blocks of one component, or of sizes that do not fit, are not compared.
    """
    own = members.join(stars.groupBy("cls").agg(F.min("centre").alias("centre")), "cls")
    leads = own.groupBy("centre").agg(_cut(F.count("*"), F.sum("n")).alias("leads"))
    salted = own.join(leads, "centre").select("cls", F.xxhash64("centre", F.pmod(F.xxhash64("cls"), "leads")).alias("block"))
    heads = leads.select(F.col("centre").alias("cls"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("leads") - 1)).alias("salt"))
    heads = heads.select("cls", F.xxhash64("cls", "salt").alias("block"))
    found = work.settle(compare(work.settle(salted.union(heads), "leads"), sets), "star-links")
    labels = components(found, work).withColumnRenamed("node", "cls")
    placed = work.settle(members.join(labels, "cls", "left").select("cls", "n", "grp", F.coalesce("label", "cls").alias("label")), "placed")
    of_label = placed.groupBy("grp", "label").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    of_label = of_label.withColumn("alone", (F.col("m") > BLOCK // 2) | (F.col("all") > BLOCK_SHINGLES // 2))
    cuts = of_label.groupBy("grp", F.when(F.col("alone"), F.col("label")).alias("one")).agg(_cut(F.sum("m"), F.sum("all")).alias("cuts"))
    of_label = work.settle(of_label.select("grp", "label", F.when(F.col("alone"), F.col("label")).alias("one")), "of-label")
    where = placed.join(of_label, ["grp", "label"])
    where = where.join(cuts.withColumnRenamed("grp", "g").withColumnRenamed("one", "o"), (F.col("grp") == F.col("g")) & F.col("one").eqNullSafe(F.col("o")))
    salt = F.pmod(F.xxhash64(F.coalesce(F.when(F.col("one").isNotNull(), F.col("cls")), "label")), "cuts")
    where = work.settle(where.select("cls", "n", "grp", "one", F.xxhash64("grp", F.coalesce("one", F.lit(0)), salt).alias("part")), "parts")
    parts = where.groupBy("grp", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("one").alias("one"))
    other = parts.toDF("grp", "part2", "lo2", "hi2", "one2")
    fits = (F.col("part") <= F.col("part2")) & (4 * F.col("hi") >= 3 * F.col("lo2")) & (4 * F.col("hi2") >= 3 * F.col("lo"))
    pairs = parts.join(other, "grp").where(fits & ~F.coalesce(F.col("one") == F.col("one2"), F.lit(False)))
    pairs = work.settle(pairs.select("part", "part2", F.xxhash64("part", "part2").alias("block")), "part-pairs")
    sides = pairs.select("part", "block").union(pairs.where("part <> part2").select("part2", "block"))
    return where.join(sides, "part").select("cls", "block"), found


def similar_components(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id: one row for each row of ``docs``.

    row_key is a hash of doc_id and text. Documents without words link with nothing
    and are components of their own, as are rows with a null doc_id (component_id
    null). Copies of one set are one class; repeated rows each get the row of their
    class. Extra columns are ignored; an empty table gives an empty result.
    """
    work = Scratch(docs.sparkSession)
    docs = documents_of(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    each = work.settle(profile(docs), "profile")
    known = each.where("doc_id is not null and n > 0")
    alive = work.settle(known.where("4 * shared >= 3 * n").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "alive")
    chosen = alive.select("doc_id", "cls")
    chosen = docs.select("doc_id", "text").join(told(chosen), "doc_id")
    sets = work.settle(chosen.mapInArrow(_sets, "cls long, n long, shingles binary"), "sets")

    n = partitions(docs.sparkSession)
    dealt = sets.mapInArrow(_sign, "sig long, cls long").repartition(n, "sig").sortWithinPartitions("sig", "cls")
    packed = dealt.mapInArrow(lambda b: _stars(b, n), "part int, pairs binary").repartitionById(n, "part")
    stars = work.settle(packed.mapInArrow(_distinct, "centre long, cls long"), "stars")
    groups = components(stars.toDF("a", "b"), work)
    members = work.settle(groups.join(alive, groups["node"] == alive["cls"]).select("cls", "n", F.col("label").alias("grp")), "members")
    cuts = work.settle(members.groupBy("grp").agg(_cut(F.count("*"), F.sum("n")).alias("cuts")), "groups")
    small = members.join(cuts.where("cuts = 1"), "grp").select("cls", F.col("grp").alias("block"))
    large = cuts.where("cuts > 1")
    if large.isEmpty():
        found = compare(small, sets)
    else:
        pairs, first = _block_pairs(members.join(large, "grp").drop("cuts"), stars, sets, work)
        found = compare(small.union(pairs), sets).union(first)
    labels = components(found, work)

    least = labels.join(alive, labels["node"] == alive["cls"]).groupBy("label").agg(F.min("doc_id").alias("linked"))
    linked = labels.join(least, "label").select(F.col("node").alias("cls"), "linked")
    of_class = known.groupBy("cls").agg(F.min("doc_id").alias("least")).join(linked, "cls", "left")
    of_class = work.settle(of_class.select("cls", F.coalesce("linked", "least").alias("component_id")), "of-class")
    work.drop(each, of_class)
    # both sides are plain tables, so that a class of very many copies can be split
    placed = known.join(of_class, "cls").select("row_key", "doc_id", "n", "component_id")
    placed = placed.union(each.where("doc_id is null or n = 0").select("row_key", "doc_id", "n", F.col("doc_id").alias("component_id")))
    return placed.withColumnRenamed("n", "n_shingles")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays, of repeated rows one.

    Rows are told apart by doc_id and text. Rows without doc_id are in no
    component and stay, of those of one text one. Other columns are kept as they
    are, whatever their names.
    """
    small_batches(spark)
    work = Scratch(spark)
    each = work.settle(similar_components(docs), "components")
    keyed, key = with_row_key(docs)
    gone = work.settle(each.where("component_id <> doc_id").select(F.col("row_key").alias(key)).distinct(), "gone")
    often = work.settle(each.groupBy(F.col("row_key").alias(key)).count().where("count > 1").select(key), "repeated")
    kept = keyed.join(told(gone), key, "left_anti")
    if not often.isEmpty():
        kept = kept.join(often, key, "left_anti").unionByName(kept.join(often, key, "left_semi").dropDuplicates([key]))
    return kept.drop(key)

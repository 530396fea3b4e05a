"""Exact similarity join on word shingles, and the groups it links.

Documents are rows, shingles are columns of a sparse 0/1 matrix A, and the overlaps of all pairs are
A times its transpose.  Only the cells that can reach the threshold are ever worked on:

1. Copies of one shingle set are one row.
2. A row takes part in the product with its prefix, the columns that stand first in one order of all
   columns, just so many that two rows without a common prefix column can't be similar.  Columns
   that many documents share come last in that order; a sketch of fixed size tells which these are.
   A prefix column with its rows is a bucket, a block of the product; a large bucket is cut into
   blocks of rows, and blocks that no pair can come from are left out.
3. Inside a block the columns are folded into groups, the more the larger a row is (a few columns of
   the row in each).  The sum over groups of the smaller count is at least the overlap; it is
   accumulated over the groups, and a pair is discarded when even its whole rest would leave it
   below the bound that its two sizes give.
4. What is left is counted exactly on whole shingle sets.

Linked documents need no further pair between them, so the search runs on components: first each
row of a bucket with the next one in size, then each row with its best partner in another component,
and last all remaining pairs across components.  For these a task gives out, not the pairs it can't
discard, but a spanning forest of them: fewer rows than it has read.  The groups that the forests
connect are the product's last blocks: the whole sets of a group's rows come together once, in blocks
of bounded size, overlap counts are accumulated exactly over the columns inside the task, and again
only a forest of the links leaves it.  No pair inside a group that is linked already is made, and no
link between two groups is lost.

Null and blank texts have no shingles and link with nothing.  A text with fewer words than a shingle
has its whole word sequence as its one shingle.  Rows with null or repeated identifiers are documents
of their own; a component's name is the smallest identifier in it, null if there is none."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import keyfilter, shingles
from .common import Workspace
from .components import components
from .groups import Groups
from .order import running_sums

#: Column groups of a small row; they double until a group has at most `_PER_CELL` columns of the row.
CELLS, _PER_CELL = 128, 4
#: The sketch: counters, and in how many documents of one window a shingle is frequent.
_COUNTERS, _FREQUENT, _WINDOW = 1 << 20, 4, 1 << 21
#: Rows of a bucket that are multiplied as one block.
BLOCK = 2048
_PAIRS = 1 << 19
#: Columns of the rows of one exact block together; rows from which a column is multiplied densely.
_ENTRIES, _DENSE = 1 << 22, 64

_ROWS = "doc_id bigint, text_key bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>, cells binary"
_ROWS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
        ("prefix", pa.list_(pa.int64())), ("cells", pa.binary()),
    ]
)


def prefix_length(n: int, percent: int) -> int:
    """A similar row shares at least ceil(percent n / 100) columns, one of them among so many."""
    return n - -(-percent * n // 100) + 1


# ------------------------------------------------------------------ frequent columns, rows


def _counter(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def frequency_levels(docs: DataFrame, size: int) -> np.ndarray:
    """For each counter the power of two of how often frequent shingles fell on it.

    A window of documents reports the shingles that several of its texts share.  Counters are as
    many at every input size, so what comes to the driver is bounded; two shingles on one counter
    only change an order in which every order is right."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(_COUNTERS, np.int64)
        window: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = 0

        def close() -> None:
            nonlocal held
            if window:
                found, times = np.unique(np.concatenate(window), return_counts=True)
                often = times >= _FREQUENT
                np.add.at(totals, _counter(found[often]), times[often])
            window.clear(), seen.clear()
            held = 0

        for batch in batches:
            for own in shingles.shingle_sets(batch["text"], size, lower=True):
                if (key := xxhash.xxh3_128_digest(own.tobytes())) not in seen:
                    seen.add(key), window.append(own)
                    held += len(own)
                    if held > _WINDOW:
                        close()
        close()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["counter", "times"])

    counted = docs.select("text").mapInArrow(count, "counter bigint, times bigint")
    sums = counted.groupBy("counter").agg(F.sum("times").alias("times")).toArrow()
    levels = np.zeros(_COUNTERS, np.uint8)
    levels[np.asarray(sums["counter"].combine_chunks())] = np.log2(np.asarray(sums["times"].combine_chunks())).astype(np.uint8) + 1
    return levels


def folded(own: np.ndarray) -> bytes:
    """Counts of a row's columns by group, four bits each; empty if one does not fit, which bounds
    nothing."""
    width = CELLS
    while width * _PER_CELL < len(own):
        width *= 2
    counts = np.bincount((own >> np.uint64(65 - width.bit_length())).astype(np.int64), minlength=width)
    return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes() if counts.max() < 16 else b""


class Folds:
    """Folded counts of many rows, at any width that a pair has in common: neighbouring groups of a
    wider row are added."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed
        self.width = np.array([2 * len(c) for c in packed], np.int64)
        self._made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, row of the matrix for each row) of the rows at least this wide."""
        if width not in self._made:
            own = np.flatnonzero(self.width >= width)
            matrix = np.zeros((len(own), width), np.uint16)
            for wide in np.unique(self.width[own]).tolist():
                same = np.flatnonzero(self.width[own] == wide)
                pairs = np.frombuffer(b"".join(self.packed[i] for i in own[same].tolist()), np.uint8)
                counts = np.stack([pairs & 15, pairs >> 4], 1)
                matrix[same] = counts.reshape(len(same), width, wide // width).sum(2, dtype=np.uint16)
            place = np.full(len(self.packed), -1)
            place[own] = np.arange(len(own))
            self._made[width] = matrix, place
        return self._made[width]

    def bounds(self, n: np.ndarray, other: Folds, m: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Upper bounds of the overlaps of the pairs of rows a and others b, -1 where discarded."""
        width = np.minimum(self.width[a], other.width[b])
        out = np.zeros(len(a), np.int64)
        for w in np.unique(width).tolist():
            same = np.flatnonzero(width == w)
            for lo in range(0, len(same), max(1, (1 << 22) // max(w, 1))):
                at = same[lo : lo + max(1, (1 << 22) // max(w, 1))]
                i, j = a[at], b[at]
                if w:
                    (left, row), (right, column) = self.at(w), other.at(w)
                    out[at] = may_link(n[i], m[j], left[row[i]], right[column[j]], percent)
                else:
                    most = np.minimum(n[i], m[j])
                    out[at] = np.where(most >= overlap_needed(n[i], m[j], percent), most, -1)
        return out


def rows_of(docs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """One row per document: set size, 128-bit digest of the set, prefix and folded counts."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own in shingles.shingle_sets(batch["text"], size, lower=True):
                if not len(own):
                    made.append((0, 0, 0, [], b""))
                    continue
                first = prefix_length(len(own), percent)
                level = shared.value[_counter(own)]
                rare = own[level == 0][:first]
                if len(rare) < first:
                    often = own[level > 0]
                    rare = np.concatenate([rare, often[np.lexsort((often, level[level > 0]))][: first - len(rare)]])
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
                made.append((len(own), d1, d2, rare.view(np.int64), folded(own)))
            columns = [batch["doc_id"], batch["text_key"], *zip(*made, strict=True)] if made else []
            if made:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ROWS_ARROW, strict=True)],
                    schema=_ROWS_ARROW,
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(rows, _ROWS)


# ------------------------------------------------------------------------- blocks of the product


def overlap_needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of rows of these sizes with 100 * both >= percent * either."""
    return -(-percent * (na + nb) // (100 + percent))


def may_link(na: np.ndarray, nb: np.ndarray, cells_a: np.ndarray, cells_b: np.ndarray, percent: int) -> np.ndarray:
    """Upper bounds of the overlaps of pairs, accumulated over the column groups; -1 where the pair is
    discarded."""
    need, bound = overlap_needed(na, nb, percent), np.zeros(len(na), np.int64)
    left_a, left_b, live = na.copy(), nb.copy(), np.arange(len(na))
    step = max(1, cells_a.shape[1] // 4)
    for lo in range(0, cells_a.shape[1], step):
        a, b = cells_a[live, lo : lo + step], cells_b[live, lo : lo + step]
        bound[live] += np.minimum(a, b).sum(1, dtype=np.int64)
        left_a[live] -= a.sum(1, dtype=np.int64)
        left_b[live] -= b.sum(1, dtype=np.int64)
        live = live[bound[live] + np.minimum(left_a[live], left_b[live]) >= need[live]]
    out = np.full(len(na), -1, np.int64)
    out[live] = bound[live]
    return out


def _pair_slabs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j inside all groups, in slabs of bounded length."""
    for g in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == g]
        if g * (g - 1) // 2 > _PAIRS:
            for s in own.tolist():
                step = max(1, _PAIRS // g)
                for lo in range(0, g, step):
                    i, j = np.meshgrid(np.arange(lo, min(g, lo + step)), np.arange(g), indexing="ij")
                    keep = i < j
                    yield s + i[keep], s + j[keep]
            continue
        i, j = np.triu_indices(g, 1)
        step = max(1, _PAIRS // len(i))
        for lo in range(0, len(own), step):
            base = own[lo : lo + step, None]
            yield (base + i).reshape(-1), (base + j).reshape(-1)


def _candidates(rows: pa.Table, percent: int, apart=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slabs (i, j, bound) of the row pairs across components, inside blocks (shingle, bi, bj), that
    can't be discarded; `apart` tells of two arrays of rows which pairs still matter."""
    n, component, block, bi, bj = (rows[c].to_numpy() for c in ("n", "component", "block", "bi", "bj"))
    key = np.stack([rows["shingle"].to_numpy(), bi, bj])
    begin = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
    folds = Folds(rows["cells"].to_pylist())
    for i, j in _pair_slabs(begin, np.diff(np.append(begin, len(n)))):
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (component[i] != component[j]) & (100 * small >= percent * large)
        ok &= (bi[i] == bj[i]) | (block[i] != block[j])
        if apart is not None:
            ok &= apart(i, j)
        i, j = i[ok], j[ok]
        bound = folds.bounds(n, folds, n, i, j, percent)
        hit = bound >= 0
        if hit.any():
            yield i[hit], j[hit], bound[hit]


def _pairs(a: np.ndarray, b: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Pairs (a, b), and one row for each bucket that has more."""
    none, other = pa.nulls(len(more), pa.int64()), pa.nulls(len(a), pa.int64())
    columns = [pa.concat_arrays([pa.array(a), none]), pa.concat_arrays([pa.array(b), none]), pa.concat_arrays([other, pa.array(more)])]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "more"])


_NONE = np.zeros(0, np.int64)


def _best_pairs(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Each row's best candidate, and the buckets that have further ones."""
    node, n, shingle = (rows[c].to_numpy() for c in ("node", "n", "shingle"))
    found = [(node[i], node[j], bound / (n[i] + n[j] - bound), shingle[i]) for i, j, bound in _candidates(rows, percent)]
    if not found:
        return _pairs(_NONE, _NONE, _NONE)
    a, b, share, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    ab, pair = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    own, other, both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([share, share])
    order = np.lexsort((other, -both, own))  # ties go to the smallest partner
    first = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])]
    chosen = np.zeros(ab.shape[1], bool)
    chosen[pair[first % len(a)]] = True
    return _pairs(*ab[:, chosen], np.unique(bucket[~chosen[pair]]))


def _forest(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """A forest that connects the rows of all candidate pairs."""
    node, place = np.unique(rows["node"].to_numpy(), return_inverse=True)
    groups = Groups(len(node))
    for i, j, _ in _candidates(rows, percent, lambda i, j: groups.least[place[i]] != groups.least[place[j]]):
        groups.link(place[i], place[j])
    linked = np.flatnonzero(groups.least != np.arange(len(node)))
    return _pairs(node[groups.least[linked]], node[linked], _NONE)


def _multiply(batches: Iterator[pa.RecordBatch], percent: int, best: bool) -> Iterator[pa.RecordBatch]:
    return _in_blocks(batches, ("shingle", "bi", "bj"), 4096, partial(_best_pairs if best else _forest, percent=percent))


def _in_blocks(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], least: int, work) -> Iterator[pa.RecordBatch]:
    """Apply a function to tables of whole blocks, each of about `least` rows, from sorted rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held)
        places = np.stack([whole[c].to_numpy().astype(np.int64) for c in key])
        change = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0))
        if len(change):  # the last block may go on in the next batch
            cut = int(change[-1]) + 1
            yield work(whole.slice(0, cut).combine_chunks())
            held, rows = whole.slice(cut).combine_chunks().to_batches(), whole.num_rows - cut
    if rows:
        yield work(pa.Table.from_batches(held).combine_chunks())


def overlaps(sets: pa.Array) -> np.ndarray:
    """The overlap counts of all pairs of rows: the product of their 0/1 matrix with its transpose,
    accumulated over the columns.  Columns of few rows add one to each pair of these; the others are
    multiplied as dense blocks."""
    rows = len(sets)
    row = np.repeat(np.arange(rows), np.diff(np.asarray(sets.offsets)))
    columns, column, times = np.unique(np.asarray(sets.flatten()), return_inverse=True, return_counts=True)
    order = np.lexsort((row, column))
    row, begin = row[order], np.concatenate([[0], np.cumsum(times)])[:-1]
    counts = np.zeros(rows * rows, np.int32)
    few = times < _DENSE
    for i, j in _pair_slabs(begin[few], times[few]):
        np.add.at(counts, row[i] * rows + row[j], 1)
    counts = counts.reshape(rows, rows)
    dense = np.flatnonzero(~few)
    step = max(1, (1 << 24) // max(rows, 1))
    for lo in range(0, len(dense), step):
        part = dense[lo : lo + step]
        matrix = np.zeros((len(part), rows), np.float32)
        for k, c in enumerate(part.tolist()):
            matrix[k, row[begin[c] : begin[c] + times[c]]] = 1
        counts += np.triu((matrix.T @ matrix).astype(np.int32), 1)
    return counts


def _links(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """A forest of the links across components inside the blocks (family, bi, bj), counted exactly."""
    key = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("family", "bi", "bj")])
    cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
    a, b = [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = rows.slice(lo, hi - lo)
        node, n, component, block = (part[c].to_numpy() for c in ("node", "n", "component", "block"))
        if (component == component[0]).all():
            continue
        both = overlaps(part["columns"].combine_chunks())
        i, j = np.nonzero((both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both)))
        other = (component[i] != component[j]) & ((key[1, lo] == key[2, lo]) | (block[i] != block[j]))
        groups = Groups(len(node))
        groups.link(i[other], j[other])
        linked = np.flatnonzero(groups.least != np.arange(len(node)))
        a.append(node[groups.least[linked]])
        b.append(node[linked])
    return _pairs(np.concatenate([_NONE, *a]), np.concatenate([_NONE, *b]), _NONE)


def _multiply_exactly(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    return _in_blocks(batches, ("family", "bi", "bj"), 512, partial(_links, percent=percent))


def _blocks(buckets: DataFrame, percent: int, block: int, work: Workspace) -> DataFrame:
    """Rows of the buckets that hold several components, with the block pair they take part in."""
    bucket = Window.partitionBy("shingle")
    order = bucket.orderBy("component", "n", "node")
    mixed = buckets.withColumn("_lo", F.min("component").over(bucket)).withColumn("_hi", F.max("component").over(bucket))
    mixed = mixed.filter(F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")
    numbered = mixed.withColumn("block", ((F.row_number().over(order) - 1) / block).cast("int"))
    numbered = work.keep(numbered)
    one = numbered.filter(F.col("rows") <= block).withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    large = numbered.filter(F.col("rows") > block)
    about = large.groupBy("shingle", "block").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1")
    )
    left, right = about.toDF("shingle", "bi", "p0", "p1", "m0", "m1"), about.withColumnRenamed("block", "bj")
    several = (F.col("p0") != F.col("p1")) | (F.col("c0") != F.col("c1")) | (F.col("p0") != F.col("c0"))
    near = (100 * F.col("m1") >= percent * F.col("n0")) & (100 * F.col("n1") >= percent * F.col("m0"))
    pairs = left.join(right, "shingle").filter((F.col("bi") <= F.col("bj")) & several & near).select("shingle", "bi", "bj")
    sides = F.explode(F.array_distinct(F.array("bi", "bj"))).alias("block")
    dealt = large.join(pairs.select("shingle", "bi", "bj", sides), ["shingle", "block"])
    columns = ["shingle", "bi", "bj", "block", "node", "n", "component"]
    return one.select(*columns).unionByName(dealt.select(*columns))


# ----------------------------------------------------------------------------------- the join


def _first(identifier: str, row: str) -> Column:
    """Smallest identifier first, null last."""
    return F.struct(F.col(identifier).isNull(), identifier, row)


class Join:
    """The steps of one join over written intermediate tables."""

    def __init__(self, docs: DataFrame, size: int, percent: int, block: int = BLOCK):
        self.work = Workspace(docs.sparkSession)
        self.docs, self.size, self.percent, self.block = docs.select("doc_id", "text"), size, percent, block
        levels = frequency_levels(self.docs, size)
        rows = rows_of(self.docs, size, percent, levels)
        self.rows = self.work.keep(rows.withColumn("row_id", F.monotonically_increasing_id()))
        some = self.rows.filter("n > 0").groupBy("n", "d1", "d2")
        self.nodes = self.work.keep(some.agg(F.min_by("row_id", _first("doc_id", "row_id")).alias("node"), F.min("doc_id").alias("first")))
        # The other copies are told apart by a filter first: only rows that may be one are moved.
        copies = self.rows.select("row_id", "n").filter("n > 0").join(self.nodes.select(F.col("node").alias("row_id")), "row_id", "left_anti")
        copies = self.work.keep(copies.select("row_id", F.xxhash64("row_id").alias("_copy")))
        some = self.rows.filter("n > 0")
        some = some.withColumn("_hit", keyfilter.may_hold(keyfilter.build(copies, "_copy"), F.xxhash64("row_id")))
        rest = some.filter("_hit").join(copies.select("row_id"), "row_id", "left_anti")
        distinct = some.filter(~F.col("_hit")).unionByName(rest.select(*some.columns))
        self.distinct = self.work.keep(distinct.select(F.col("row_id").alias("node"), "n", "doc_id", "text_key", "prefix", "cells"))
        self.labels: DataFrame | None = None

    def buckets(self) -> DataFrame:
        """(shingle, node, n, rows, before): prefix columns of at least two rows of similar size."""
        bucket = Window.partitionBy("shingle")
        exploded = self.distinct.select("node", "n", F.explode("prefix").alias("shingle"))
        counted = exploded.withColumn("rows", F.count("*").over(bucket)).filter("rows > 1")
        order = bucket.orderBy("n", "node")
        sized = counted.withColumns({"before": F.lag(F.struct("node", "n")).over(order), "_above": F.lead("n").over(order)})
        # Rows are in order of size: one whose neighbours are too small and too large has no partner.
        below = 100 * F.col("before.n") >= self.percent * F.col("n")
        above = 100 * F.col("n") >= self.percent * F.col("_above")
        near = F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))
        return self.work.keep(sized.filter(near).drop("_above"))

    def neighbours(self, buckets: DataFrame) -> DataFrame:
        """Pairs of a bucket's rows that follow each other in size."""
        near = F.col("before").isNotNull() & (100 * F.col("before.n") >= self.percent * F.col("n"))
        pairs = buckets.filter(near).select(F.least("node", "before.node").alias("a"), F.greatest("node", "before.node").alias("b"))
        return self._bounded(pairs.distinct())

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent

        @F.arrow_udf("boolean")
        def passes(na: pa.Array, nb: pa.Array, ca: pa.Array, cb: pa.Array) -> pa.Array:
            every = np.arange(len(na))
            return pa.array(Folds(ca.to_pylist()).bounds(na.to_numpy(), Folds(cb.to_pylist()), nb.to_numpy(), every, every, percent) >= 0)

        side = lambda x: self.distinct.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        return joined.filter(passes("na", "nb", "ca", "cb")).select("a", "b")

    def candidates(self, buckets: DataFrame, best: bool) -> DataFrame:
        labels = self.labels.withColumnRenamed("node", "_node")
        labelled = buckets.drop("before").join(labels, F.col("node") == F.col("_node"), "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        blocks = _blocks(labelled.drop("_node"), self.percent, self.block, self.work)
        cells = self.distinct.select(F.col("node").alias("_node"), "cells")
        rows = blocks.join(cells, F.col("node") == F.col("_node")).drop("_node")
        placed = rows.repartition("shingle", "bi", "bj").sortWithinPartitions("shingle", "bi", "bj")
        found = placed.mapInArrow(partial(_multiply, percent=self.percent, best=best), "a bigint, b bigint, more bigint")
        return self.work.keep(found.distinct())

    def sets_of(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is known of some nodes, and the shingle sets (doc_id, text_key, columns) of their rows."""
        known = self.distinct.select("node", "n", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
        wanted = self.work.keep(known.join(nodes, "node"))
        size, table = self.size, self.docs.sparkSession.sparkContext.broadcast(keyfilter.build(wanted, "_key"))

        def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple] = set()  # a task gives a row that repeats once
            for batch in batches:
                keys = list(zip(batch["text_key"].to_pylist(), batch["doc_id"].to_pylist(), strict=True))
                held = keyfilter.holds(table.value, batch["text_key"].to_numpy())
                for i in np.flatnonzero(held).tolist():
                    held[i] = keys[i] not in seen
                    seen.add(keys[i])
                hit = batch.filter(pa.array(held))
                for lo, texts in shingles.pieces(hit["text"], 1 << 22):
                    own = [s.view(np.int64) for s in shingles.shingle_sets(texts, size, lower=True)]
                    part = hit.slice(lo, len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_id"], part["text_key"], pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "text_key", "columns"]
                    )

        # Whole texts are not moved: the shingle sets of the rows asked for are.
        keyed = self.docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        made = keyed.mapInArrow(columns, "doc_id bigint, text_key bigint, columns array<bigint>")
        return wanted, self.work.keep(made)

    def link(self, candidates: DataFrame) -> None:
        """Count the overlaps of candidate pairs exactly and merge what is linked."""
        pairs = self.work.keep(candidates.select("a", "b"))
        if self.labels is not None and pairs.isEmpty():
            return
        wanted, sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        # A repeated row may have its set from several tasks; its pairs then come as often, as one link.
        for x in "ab":
            named = wanted.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("_key").alias(f"k{x}"), F.col("_doc").alias(f"d{x}"))
            pairs = pairs.join(named, x)
        for x in "ab":
            own = sets.select(F.col("text_key").alias("_k"), F.col("doc_id").alias("_d"), F.col("columns").alias(f"s{x}"))
            pairs = pairs.join(own, (F.col(f"k{x}") == F.col("_k")) & F.col(f"d{x}").eqNullSafe(F.col("_d"))).drop("_k", "_d")
        both = F.size(F.array_intersect("sa", "sb"))
        linked = pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), both.alias("both"))
        links = linked.filter(100 * F.col("both") >= self.percent * (F.col("n") - F.col("both"))).select("a", "b")
        if self.labels is not None:
            links = links.unionByName(self.labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.labels = components(links, self.work)

    def settle(self, forest: DataFrame) -> None:
        """Find all links among the rows that a forest of candidates connects, and merge what is linked."""
        families = components(forest.select("a", "b"), self.work).withColumnRenamed("component", "family")
        labels = self.labels.withColumnRenamed("node", "_node")
        wanted, sets = self.sets_of(families.select("node"))
        named = wanted.join(families, "node").join(labels, F.col("node") == F.col("_node"), "left")
        named = named.withColumn("component", F.coalesce("component", "node")).drop("_node")
        # Rows in order of size are cut into blocks of bounded rows and columns.
        sums = {"rows": F.lit(1).cast("long"), "entries": F.col("n")}
        placed = running_sums(named, self.work, ["family"], ["n", "node"], sums)
        last = placed.withColumn("cut", F.floor(F.col("rows") / max(1, self.block // 2)) + F.floor(F.col("entries") / (_ENTRIES // 2)))
        members = self.work.keep(last.withColumnRenamed("cut", "block").drop("rows", "entries"))
        about = members.groupBy("family", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"))
        left, right = about.toDF("family", "bi", "m0", "m1"), about.withColumnRenamed("block", "bj")
        near = (100 * F.col("m1") >= self.percent * F.col("n0")) & (F.col("bi") <= F.col("bj"))
        sides = F.explode(F.array_distinct(F.array("bi", "bj"))).alias("block")
        pairs = left.join(right, "family").filter(near).select("family", "bi", "bj", sides)
        same = (F.col("_key") == F.col("text_key")) & F.col("_doc").eqNullSafe(F.col("doc_id"))
        with_sets = members.join(sets, same).select("family", "block", "node", "n", "component", "columns")
        # A repeated row may have its set from several tasks: its copies link with each other alike.
        dealt = with_sets.join(pairs, ["family", "block"]).repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj")
        found = dealt.mapInArrow(partial(_multiply_exactly, percent=self.percent), "a bigint, b bigint, more bigint")
        links = self.work.keep(found.select("a", "b"))
        known = self.labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        self.labels = components(links.unionByName(known), self.work)

    def run(self) -> DataFrame:
        """Per document row: row_id, doc_id, text_key, n and component_id."""
        buckets = self.buckets()
        self.link(self.neighbours(buckets))
        found = self.candidates(buckets, best=True)
        self.link(found.filter("more IS NULL"))
        # Only buckets with further pairs are gone through again.
        more = found.filter("more IS NOT NULL").select(F.col("more").alias("shingle")).distinct()
        rest = self.work.keep(buckets.join(more, "shingle", "left_semi"))
        if not rest.isEmpty():
            forest = self.candidates(rest, best=False)
            if not forest.isEmpty():
                self.settle(forest)
        labels = self.labels.withColumnRenamed("node", "_node")
        labelled = self.nodes.join(labels, F.col("node") == F.col("_node"), "left").drop("_node")
        labelled = self.work.keep(labelled.withColumn("component", F.coalesce("component", "node")))
        named = labelled.groupBy("component").agg(F.min("first").alias("component_id"), F.min_by("node", _first("first", "node")).alias("keeper"))
        named = self.work.keep(labelled.join(named, "component").select("n", "d1", "d2", "component_id", "keeper"))
        rows = self.rows.select("row_id", "doc_id", "text_key", "n", "d1", "d2")
        joined = rows.join(named, ["n", "d1", "d2"], "left")
        empty = F.col("n") == 0
        return joined.select(
            "row_id", "doc_id", "text_key", "n",
            F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(empty, F.col("row_id")).otherwise(F.col("keeper")).alias("keeper"),
        )


def link_components(docs: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of (doc_id, text): two documents are linked
    when 100 times their common shingles is at least `percent` times their shingles together."""
    return Join(docs, size, percent, block).run().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_per_component(docs: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """The documents, with all their columns, without those that another one of their component
    stands for.  Texts without words all stay; of rows equal in doc_id and text one stays."""
    join = Join(docs, size, percent, block)
    stays = (F.col("row_id") == F.col("keeper")).cast("int")
    keys = join.run().groupBy("doc_id", "text_key").agg(F.max(stays).alias("stays"), F.count("*").alias("times"), F.max("n").alias("n"))
    again = (F.col("stays") == 1) & (F.col("times") > 1) & (F.col("n") > 0)
    flags = join.work.keep(
        keys.filter((F.col("stays") == 0) | again)
        .select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), again.alias("_again"))
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("_own"))
    rows = rows.withColumn("_hit", keyfilter.may_hold(keyfilter.build(flags, "_key"), F.col("_own")))
    # Only texts whose key may be flagged are moved.
    passed = rows.filter(~F.col("_hit")).select("row.*")
    same = (rows["_own"] == flags["_key"]) & rows["row.doc_id"].eqNullSafe(flags["_doc"])
    joined = rows.filter("_hit").join(flags, same, "left")
    kept = passed.unionByName(joined.filter(F.col("_again").isNull()).select("row.*"))
    if flags.filter("_again").isEmpty():
        return kept
    repeated = joined.filter("_again").withColumns({"_id": F.col("row.doc_id")}).dropDuplicates(["_id", "_own"])
    return kept.unionByName(repeated.select("row.*"))

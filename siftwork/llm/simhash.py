"""SimHash fingerprints and the groups that near ones link, by a binary trie joined with itself.

A fingerprint has a bit set where over half of the text's shingle hashes have it.  Two fingerprints
are linked when they differ in at most `budget` bits.

The join goes through pairs of trie nodes: from a pair to the pairs of their children, adding one to
the pair's differing bits where the children's bits are different, and a pair beyond the budget is
dropped with all that is below it.  A node is a range of the sorted fingerprints, so a step is done
for many pairs at once.

To spread it, the 64 bits are cut into budget + 1 parts; fingerprints within the budget agree in one
of them.  There is one trie for each part, with that part's bits on top: its traversal starts at the
nodes below them, where a fingerprint meets only those with the same part, and every node is a unit
of work of its own.  A node with more than `UNIT` fingerprints is descended in Spark in the same way,
pair by pair of counted nodes, until the two sides of each pair are small enough for one task; the
rows then go to the pairs of their node.  So no unit exceeds `UNIT` rows, and none is left out.

What a unit gives out is not its pairs but, for each fingerprint that is linked to a smaller one, one
edge to the smallest of its group: fewer rows than it has read.  Node pairs that lie inside one group
already are not descended.  Equal fingerprints are one row from the start.

Null and blank texts have no shingles: their fingerprint is zero, linked like any other.  A text with
fewer words than a shingle has its whole word sequence as its one shingle.  Rows with null or repeated
identifiers are documents of their own; a component's name is the smallest identifier in it, null if
it has none.  Texts are read whole, in pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import Workspace
from .components import components
from .groups import Groups

SHINGLE, SEED, BUDGET = 3, 42, 3
BITS = 64
#: Fingerprints of one unit of work at most, and trie levels that Spark descends at a time.
UNIT, STEP = 1 << 15, 2
#: Node pairs of at most so many fingerprint pairs are compared directly; pairs handled at once.
_DIRECT, _SLAB = 32, 1 << 18
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# -------------------------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every window of `size` lower-cased words joined by a space, a piece of text at a time."""
    digest, carried, complete, lo = xxhash.xxh64_intdigest, [], False, 0
    while lo < len(text):
        hi = len(text)
        if hi - lo > _PIECE and (space := _SPACE.search(text, lo + _PIECE)):
            hi = space.start()
        words = carried + text[lo:hi].lower().split()
        lo = hi
        if len(words) < size:
            carried = words
            continue
        complete = True
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - size]]
        yield np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)
        carried = words[len(words) - size + 1 :] if size > 1 else []
    if carried and not complete:
        yield np.array([digest(b" ".join(carried), seed)], np.uint64)


def _bit_counts(hashes: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """For each owner and bit, how many of its hashes have the bit."""
    out = np.zeros((owners, BITS), np.int64)
    for k in range(8):
        byte = ((hashes >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        seen = np.bincount(owner * 256 + byte, minlength=owners * 256).reshape(owners, 256)
        out[:, 8 * k : 8 * k + 8] = seen @ _ONES
    return out


def fingerprints(texts: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprints of an array of texts, as unsigned 64-bit numbers."""
    data, offsets = shingles.text_bytes(texts)
    ones, n = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    total = 0

    def close() -> None:
        if held:
            first = held[0][0]
            owner = np.repeat([i - first for i, _ in held], [len(h) for _, h in held])
            count = held[-1][0] - first + 1
            ones[first : first + count] += _bit_counts(np.concatenate([h for _, h in held]), owner, count)
            n[first : first + count] += np.bincount(owner, minlength=count)
            held.clear()

    for i in range(len(texts)):
        for own in shingle_hashes(data[offsets[i] : offsets[i + 1]].tobytes(), size, seed):
            held.append((i, own))
            total += len(own)
            if total > 1 << 18:
                close()
                total = 0
    close()
    return ((2 * ones > n[:, None]).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows with their fingerprint as a (signed) bigint of the same bits: no shuffle."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts, size, seed).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# ------------------------------------------------------------------- the trie, inside one task


def _compare(v: np.ndarray, la, ha, lb, hb, budget: int, groups: Groups) -> None:
    """Compare all fingerprints of the first node of each pair with all of the second."""
    na, nb = ha - la, hb - lb
    total = na * nb
    pair = np.repeat(np.arange(len(la)), total)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
    i, j = la[pair] + k // nb[pair], lb[pair] + k % nb[pair]
    own = i != j
    i, j = i[own], j[own]
    near = np.bitwise_count(v[i] ^ v[j]) <= budget
    groups.link(i[near], j[near])


def _first_set(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """In each range of rows that agree above the bit, where those with the bit begin."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_] + hi[open_]) >> 1
        there = (v[middle] >> np.uint64(bit)) & np.uint64(1) > 0
        hi[open_[there]] = middle[there]
        lo[open_[~there]] = middle[~there] + 1
    return lo


def trie_join(v: np.ndarray, la, ha, lb, hb, diff, depth: int, budget: int, groups: Groups) -> None:
    """Link the rows of `v` that differ in at most `budget` bits, between the two nodes of each pair.
    A node is a range [l, h) of sorted rows that agree in the first `depth` bits; `diff` counts the
    bits among these in which the nodes of a pair differ; a node may be paired with itself."""
    stack = [(depth, la, ha, lb, hb, diff)]
    while stack:
        depth, *pairs = stack.pop()
        if len(pairs[0]) > _SLAB:
            stack.append((depth, *(x[_SLAB:] for x in pairs)))
            pairs = [x[:_SLAB] for x in pairs]
        apart = ~groups.one(*pairs[:4])
        la, ha, lb, hb, diff = (x[apart] for x in pairs)
        few = ((ha - la) * (hb - lb) <= _DIRECT) | (depth == BITS)
        if few.any():
            _compare(v, la[few], ha[few], lb[few], hb[few], budget, groups)
        la, ha, lb, hb, diff = (x[~few] for x in (la, ha, lb, hb, diff))
        if not len(la):
            continue
        ma, mb = _first_set(v, la, ha, BITS - 1 - depth), _first_set(v, lb, hb, BITS - 1 - depth)
        other = la != lb  # a node with itself has one pair of unlike children, not two
        for a0, a1, b0, b1, more, has in (
            (la, ma, mb, hb, 1, True), (ma, ha, lb, mb, 1, other), (la, ma, lb, mb, 0, True), (ma, ha, mb, hb, 0, True),
        ):
            go = (a1 > a0) & (b1 > b0) & (diff + more <= budget) & has
            if go.any():
                stack.append((depth + 1, a0[go], a1[go], b0[go], b1[go], diff[go] + more))


def link_units(rows: pa.Table, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest of its group) inside the units of work (part, depth, pa, pb)."""
    unit = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("part", "depth", "pa", "pb")])
    v = rows["value"].to_numpy().view(np.uint64)
    order = np.lexsort((v, *unit[::-1]))
    unit, v, own = unit[:, order], v[order], rows["fingerprint"].to_numpy()[order]
    new = np.concatenate([[True], (unit[:, 1:] != unit[:, :-1]).any(0)])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(v))
    groups = Groups(len(v))
    # Neighbours in the order first: what they link need not be descended.
    i = np.flatnonzero(~new)
    i = i[np.bitwise_count(v[i] ^ v[i - 1]) <= budget]
    groups.link(i - 1, i)
    depth, a, b = unit[1, begin], unit[2, begin].view(np.uint64), unit[3, begin].view(np.uint64)
    # Rows of the lower node of a pair stand before those of the higher one.
    low = v >> np.repeat(BITS - depth, end - begin).astype(np.uint64) == np.repeat(np.minimum(a, b), end - begin)
    middle = np.where(a == b, begin, begin + np.add.reduceat(low, begin, dtype=np.int64))
    ha = np.where(a == b, end, middle)
    diff = np.bitwise_count(a ^ b).astype(np.int64)
    filled = (ha > begin) & (end > middle) & (end - begin > 1)
    for d in np.unique(depth[filled]).tolist():
        at = np.flatnonzero(filled & (depth == d))
        trie_join(v, begin[at], ha[at], middle[at], end[at], diff[at], d, budget, groups)
    linked = np.flatnonzero(groups.least != np.arange(len(v)))
    return own[linked], own[groups.least[linked]]


def _link_task(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by unit, taking whole units together until they are many rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 2 * UNIT:
            continue
        whole = pa.Table.from_batches(held)
        key = np.stack([whole[c].to_numpy().astype(np.int64) for c in ("part", "depth", "pa", "pb")])
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
        if len(change):  # the last unit may go on in the next batch
            cut = int(change[-1]) + 1
            yield _edges(whole.slice(0, cut), budget)
            held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
    if rows:
        yield _edges(pa.Table.from_batches(held), budget)


def _edges(rows: pa.Table, budget: int) -> pa.RecordBatch:
    a, b = link_units(rows, budget)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


# ---------------------------------------------------------------------------- the trie, in Spark


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("value", BITS - depth)


def _rotated(fingerprint: Column, by: int) -> Column:
    return F.shiftleft(fingerprint, by).bitwiseOR(F.shiftrightunsigned(fingerprint, BITS - by)) if by else fingerprint


def _units_of(rows: DataFrame, depth: int, budget: int, unit: int, work: Workspace) -> DataFrame:
    """The rows (part, value, fingerprint) of one trie with their units (depth, pa, pb)."""
    counted = work.keep(rows.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    large = counted.filter(F.col("n") > unit)
    at_top = rows.withColumn("p", _prefix(depth))
    # A row alone in its node meets nothing.
    small = at_top.join(counted.filter(F.col("n") <= unit).select("p"), "p", "left_semi")
    units = [small.select("part", F.lit(depth).alias("depth"), F.col("p").alias("pa"), F.col("p").alias("pb"), "value", "fingerprint")]
    pairs = large.select(F.col("p").alias("pa"), F.col("p").alias("pb"), F.lit(0).alias("diff"))
    while not pairs.isEmpty():
        step = min(STEP, BITS - depth)
        nodes = pairs.select(F.explode(F.array("pa", "pb")).alias("up")).distinct()
        inside = rows.withColumn("up", _prefix(depth)).join(nodes, "up", "left_semi")
        depth += step
        children = work.keep(inside.groupBy("up", _prefix(depth).alias("p")).agg(F.count("*").alias("n")))
        a, b = children.toDF("pa", "ca", "na"), children.toDF("pb", "cb", "nb")
        met = pairs.join(a, "pa").join(b, "pb").withColumn("diff", F.col("diff") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) -
                                                           F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))))
        met = met.filter((F.col("diff") <= budget) & ((F.col("pa") != F.col("pb")) | (F.col("ca") <= F.col("cb"))))
        rows_in = F.when(F.col("ca") == F.col("cb"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        met = work.keep(met.select(F.col("ca").alias("pa"), F.col("cb").alias("pb"), "diff", rows_in.alias("n")).filter("n > 1"))
        sides = met.filter(F.col("n") <= unit).select("pa", "pb", F.explode(F.array_distinct(F.array("pa", "pb"))).alias("p"))
        dealt = inside.withColumn("p", _prefix(depth)).join(sides, "p")
        units.append(dealt.select("part", F.lit(depth).alias("depth"), "pa", "pb", "value", "fingerprint"))
        pairs = met.filter(F.col("n") > unit).drop("n")
    out = units[0]
    for more in units[1:]:
        out = out.unionByName(more)
    return out


def near_edges(fingerprints: DataFrame, work: Workspace, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (bigint) within the budget of each other,
    directly or through others."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    units = None
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        rows = fingerprints.select(F.lit(part).alias("part"), _rotated(F.col("fingerprint"), lo).alias("value"), "fingerprint")
        made = _units_of(rows, hi - lo, budget, unit, work)
        units = made if units is None else units.unionByName(made)
    key = ["part", "depth", "pa", "pb"]
    placed = units.repartition(*key).sortWithinPartitions(*key)
    return placed.mapInArrow(partial(_link_task, budget=budget), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET, seed: int = SEED, unit: int = UNIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of (doc_id, text)."""
    work = Workspace(docs.sparkSession)
    rows = work.keep(with_fingerprint(docs.select("doc_id", "text"), size=size, seed=seed).select("doc_id", "fingerprint"))
    distinct = work.keep(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    labels = components(near_edges(distinct.select("fingerprint"), work, budget, unit), work)
    labelled = distinct.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint")
    named = labelled.groupBy("component").agg(F.min("first").alias("named"))
    linked = work.keep(labels.join(named, "component").select(F.col("node").alias("fingerprint"), "named"))
    known = distinct.join(linked, "fingerprint", "left")
    # `named` is null too where no member of a component has an identifier, and so is `first` then.
    known = known.select("fingerprint", F.coalesce("named", "first").alias("component_id"))
    joined = rows.join(known, "fingerprint")
    return joined.select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")

"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range.  It therefore grows
with the document, two sketches can be merged by a union, and the share of one sketch that the
other one holds estimates containment also between a paragraph and a book.

A fingerprint is text: the number of shingles and a check number of all of them (both hex), then
the retained hashes in ascending order, cut to 32 bits, in base64: `n.check.hashes`.  Equal texts
have equal fingerprints.  Null and empty texts, and texts of white space, have the fingerprint
`0.0.`; a text with fewer words than a shingle has its whole word sequence as its one shingle."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import Workspace

SHINGLE = 5
#: Hashes below 2^64 / SCALE are retained.
SCALE = 4
_BYTES = 4  # of a retained hash in the fingerprint

Sketch = tuple[int, int, np.ndarray]


def sketch_of(own: np.ndarray, scale: int = SCALE) -> Sketch:
    """(number of shingles, check number, retained hashes) of the sorted distinct shingle hashes."""
    low = own[: np.searchsorted(own, np.uint64((2**64 - 1) // scale), "right")]
    check = int(np.bitwise_xor.reduce(own) & np.uint64(0xFFFFFFFF)) if len(own) else 0
    return len(own), check, np.unique(low >> np.uint64(64 - 8 * _BYTES - scale.bit_length() + 1))


def encode(sketch: Sketch) -> str:
    n, check, kept = sketch
    raw = kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()
    return f"{n:x}.{check:x}.{base64.b64encode(raw).decode()}"


def decode(fingerprint: str) -> Sketch:
    n, check, raw = fingerprint.split(".")
    packed = np.frombuffer(base64.b64decode(raw), np.uint8).reshape(-1, _BYTES)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :_BYTES] = packed
    return int(n, 16), int(check, 16), wide.reshape(-1).view("<u8").astype(np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of common shingles among all shingles of both.  Sketches of the same
    shingle set have 1; where neither retains a hash nothing in common was seen: 0."""
    if a[:2] == b[:2] and len(a[2]) == len(b[2]) and (a[2] == b[2]).all():
        return 1.0
    shared = _shared(a[2], b[2])
    return shared / max(1, len(a[2]) + len(b[2]) - shared)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of `a` that `b` has too."""
    if a[:2] == b[:2]:
        return likeness(a, b)
    return _shared(a[2], b[2]) / max(1, len(a[2]))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """Sketch of the two documents together; the number of shingles is then an estimate."""
    kept = np.union1d(a[2], b[2])
    shared = len(a[2]) + len(b[2]) - len(kept)
    estimate = a[0] + b[0] - round(shared * max(a[0], b[0]) / max(1, len(a[2]), len(b[2])))
    return max(a[0], b[0], estimate), a[1] ^ b[1], kept


def fingerprints(texts: pa.Array, size: int = SHINGLE, scale: int = SCALE) -> Iterator[Sketch]:
    for own in shingles.shingle_sets(texts, size):
        yield sketch_of(own, scale)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", size=SHINGLE, scale=SCALE):
    """The rows with their fingerprint: no shuffle, texts of any length whole."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([encode(s) for s in fingerprints(texts, size, scale)], pa.string())

    return docs.withColumn(out, of(F.col(text)))


# ------------------------------------------------------------------ fingerprints along an order

#: Rows of a part of the order on average, and keys of a part among those that the parts are cut by.
PART, _SAMPLED = 1 << 13, 16
_COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_edited double"
)
_TYPES = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _COMPARED.split(", "))])


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str], wanted: list[bool], size: int, scale: int) -> Iterator[tuple]:
    """Rows of the wanted documents, each compared with its edited text and the next one."""
    at = [i for i, w in enumerate(wanted) if w]
    edits = [_edited(texts[i], texts[i + 1]) for i in at]
    own = list(fingerprints(pa.array(texts, pa.large_string()), size, scale))
    changed = fingerprints(pa.array(edits, pa.large_string()), size, scale)
    for i, edit, sketch in zip(at, edits, changed, strict=True):
        yield (
            ids[i], len(texts[i]), hashlib.sha256(edit.encode()).hexdigest(), encode(own[i]), encode(sketch),
            likeness(own[i], sketch), likeness(own[i], own[i + 1]), containment(own[i], sketch),
        )


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _keys(ids: pa.Array, ties: pa.Array) -> np.ndarray:
    """Keys as bytes that sort like (doc_id, null first; tie)."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = np.asarray(ids.is_valid())
    for lo, column in ((1, ids.fill_null(-(2**63))), (9, ties)):
        out[:, lo : lo + 8] = (column.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").reshape(-1)


def _cuts(keyed: DataFrame, part: int) -> np.ndarray:
    """First keys of the parts of the order: the least of all, and every so manieth of a sample that
    is drawn by hash and grows with the number of parts."""
    parts = -(-keyed.count() // part) or 1
    key = F.struct("doc_id", "tie")
    least = keyed.agg(F.min(key).alias("key")).select("key.doc_id", "key.tie")
    drawn = keyed.orderBy(F.xxhash64("doc_id", "tie"), "doc_id", "tie").limit(parts * _SAMPLED)
    rows = least.unionByName(drawn.select("doc_id", "tie")).toArrow()
    found = np.sort(_keys(rows["doc_id"].combine_chunks(), rows["tie"].combine_chunks()))
    return np.unique(np.concatenate([found[:1], found[_SAMPLED::_SAMPLED]]))


def compare_with_next(docs: DataFrame, size: int = SHINGLE, scale: int = SCALE, part: int = PART) -> DataFrame:
    """For each document (doc_id, text) its fingerprint, that of its edited text (the second half
    replaced by the beginning of the next document's text) and how alike they are.

    The order is ascending doc_id, null first; rows with one doc_id are ordered by a hash of their
    text, and equal rows follow each other.  After the last document comes the first.  A null text
    counts as empty.  The order is cut at keys that occur into parts of about `part` rows, however
    often an identifier repeats (rows equal in doc_id and text stay together), and the first row of a
    part also goes to the end of the part before.  So one shuffle is all that is moved or written; a
    task walks through a part holding two batches.  The driver holds one key per part and its sample."""
    spark = docs.sparkSession
    Workspace(spark)  # batches of a size for texts
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    if keyed.isEmpty():
        return spark.createDataFrame([], _COMPARED)
    first = spark.sparkContext.broadcast(_cuts(keyed.select("doc_id", "tie"), part))
    count = len(first.value)

    @F.arrow_udf("array<struct<part:int,again:boolean>>")
    def parts_of(ids: pa.Array, ties: pa.Array) -> pa.Array:
        key = _keys(ids, ties)
        at = np.searchsorted(first.value, key, "right") - 1
        starts = first.value[at] == key
        before = (at - 1) % count
        rows = [[(a, False), (b, True)] if s else [(a, False)] for a, b, s in zip(at.tolist(), before.tolist(), starts.tolist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("part", pa.int32()), ("again", pa.bool_())])))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for lo, some in shingles.pieces(batch["text"], 1 << 22):
                ids, again = (batch[c].slice(lo, len(some)).to_pylist() for c in ("doc_id", "again"))
                texts = [t or "" for t in some.to_pylist()]
                if held is not None:
                    ids, texts, again = [held[0], *ids], [held[1], *texts], [held[2], *again]
                held = (ids[-1], texts[-1], again[-1])
                # Every row of a part has its next one behind it; the last is another part's first.
                wanted = [not a for a in again[:-1]]
                yield _frame(list(_compare(ids, texts, [*wanted, False], size, scale)))

    placed = keyed.select("doc_id", "text", "tie", F.inline(parts_of("doc_id", "tie")))
    order = ["part", "again", "doc_id", "tie"]
    dealt = placed.repartitionById(count, "part").sortWithinPartitions(*order)  # a part is a task
    return dealt.select("doc_id", "text", "again").mapInArrow(walk, _COMPARED)

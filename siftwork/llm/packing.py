"""Best-fit packing of documents into sequences under several capacities at once.

A document becomes its token ids and an end mark; only one longer than a sequence is cut, into full
pieces, with the shorter one first.  A sequence has three capacities: tokens, documents, and
attention cost (the sum of squared piece lengths).  Pieces are placed in order of falling length.
Among the open sequences that have room under every capacity, vector best fit takes the one where
the residual capacities, each relative to its whole, fit the piece best: by the smallest weighted
norm of what would be left (`norm`), or by the largest weighted dot product of piece and residual
(`dot`).  If none has room, a sequence is opened.

The ids are those of the tokenizer file as it is loaded: the strings of its added tokens (such as
`<|endoftext|>`) in a text are these tokens.

Full pieces are sequences of their own, and so is a piece that alone exceeds the attention capacity,
which is one of sequences of several pieces.  The others are dealt by a hash of their place in the
written table into blocks of about `BLOCK` pieces, and a block is packed by one task; every block
ends with a few sequences that are not full.  A null or empty text is a document with the end mark
only.  Rows with one doc_id, or equal ones, are documents of their own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import Workspace

LENGTH = 2048
END = 0
BLOCK = 8192
#: Capacities of a sequence: documents and attention cost.  These never bind, for the fewest sequences.
DOCUMENTS, ATTENTION = LENGTH, LENGTH * LENGTH
#: Weights of tokens, documents and attention cost in the choice.
CHOICE = (1.0, 0.001, 0.01)


def token_ids(encoding, text: str | None) -> np.ndarray:
    """Ids of a whole text and the end mark."""
    return np.append(vocab.byte_ids(encoding, text), END).astype("<u4")


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % length if n > length and n % length else min(n, length)
    starts = [0, *range(first, n, length)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("token_ids", pa.list_(pa.int32())),
    ]
)


def pieces(docs: DataFrame, length: int = LENGTH, keep_ids: bool = True, tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, token_ids]) of the tokenized documents."""
    path = tokenizer or vocab.byte_file()
    schema = _PIECES if keep_ids else pa.schema(list(_PIECES)[:-1])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocab.byte_level(path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = token_ids(encoding, text.as_py())
                for number, (start, n) in enumerate(cut(len(ids), length)):
                    own = ids[start : start + n]
                    row = (doc_id, number, start, n, zlib.crc32(own.tobytes()))
                    rows.append((*row, own.astype(np.int32)) if keep_ids else row)
                held += len(ids) if keep_ids else 0
                if held > 1 << 18:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(
        tokenize, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", token_ids array<int>" * keep_ids
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def best_fit(
    lengths: np.ndarray, length: int = LENGTH, documents: int = DOCUMENTS, attention: int = ATTENTION, choice=CHOICE, by: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece.  A piece that no empty sequence could hold is an error."""
    whole = np.array([length, documents, attention], float)
    weight = np.array(choice, float)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return sequence, offset
    order = np.argsort(-lengths, kind="stable")
    need = np.stack([lengths, np.ones_like(lengths), lengths.astype(np.int64) ** 2], 1)
    if (need > whole).any() or documents < 1:
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    least = need[order[-1]]
    left = np.zeros((len(lengths), 3), np.int64)  # residual capacities of the open sequences
    names = np.zeros(len(lengths), np.int64)
    opened = used = 0
    for i in order.tolist():
        piece = need[i]
        room = left[:used]
        fits = np.flatnonzero((room >= piece).all(1))
        if len(fits):
            if by == "norm":
                value = -((((room[fits] - piece) / whole) ** 2) @ weight)
            else:
                value = (room[fits] / whole * (piece / whole)) @ weight
            at = int(fits[value.argmax()])
        else:
            at = used
            left[at], names[at] = whole, opened
            used, opened = used + 1, opened + 1
        sequence[i], offset[i] = names[at], length - left[at, 0]
        left[at] -= piece
        if (left[at] < least).any():  # nothing that is still to come fits
            used -= 1
            left[at], names[at] = left[used], names[used]
    return sequence, offset


def pack(parts: DataFrame, work: Workspace, length: int = LENGTH, block: int = BLOCK, **capacities) -> DataFrame:
    """The rows of a written piece table (with any further columns) with sequence_id and offset."""
    placed = parts.withColumn("_place", F.monotonically_increasing_id())
    alone = (F.col("length") == length) | (F.col("length") * F.col("length") > capacities.get("attention", ATTENTION))
    full, rest = placed.filter(alone), placed.filter(~alone)
    blocks = -(-rest.count() // block) or 1
    fields = parts.schema.fields
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id bigint, offset bigint"
    # A sequence of pieces is numbered even, that of a full piece odd.
    full = full.select(*parts.columns, (F.col("_place") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def pack_block(rows: pa.Table) -> pa.Table:
        number = rows["_block"][0].as_py()
        rows = rows.drop_columns(["_block", "_place"]).take(np.argsort(rows["_place"].to_numpy()))
        sequence, offset = best_fit(rows["length"].to_numpy(), length, **capacities)
        sequence_id = (sequence << 1) + (number << 32)
        return rows.append_column("sequence_id", pa.array(sequence_id)).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_place"), F.lit(blocks)))
    return full.unionByName(dealt.groupBy("_block").applyInArrow(pack_block, out))


def pack_documents(docs: DataFrame, keep_ids: bool = True, tokenizer: str | None = None, **capacities) -> DataFrame:
    """Documents (doc_id, text) as placed pieces: a sequence is the token_ids of its pieces by offset."""
    work = Workspace(docs.sparkSession)
    if keep_ids:  # the ids travel with the pieces
        capacities.setdefault("block", BLOCK // 4)
    return pack(work.keep(pieces(docs, LENGTH, keep_ids, tokenizer)), work, **capacities)

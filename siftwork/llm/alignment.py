"""Alignment of the tokens of two tokenizers over a corpus, in Arrow.

A document is encoded by a byte-level tokenizer (A, of a space and the text) and by a piece model
(B, of the text, in front of which it puts a space itself).  Both cut the same bytes.  Where tokens
of both end, a group ends; an A and a B token are linked where their byte ranges overlap.

Inside a task, over Arrow arrays: the id lists are flattened with their parent indices, the lengths
of the tokens give their ends by a segmented cumulative sum, and a hash join of the two sides on
(text, end) yields the ends of either one in order: each is the end of one link, between the next
token end of A and that of B, and those on both sides end groups.  Neither tokenizer puts a token
across the start of a word (a space between two characters that are no white space), so a slab of
texts is first cut there and each distinct word is aligned once; documents are put together from
their words.

An id pair counts in how many documents it is linked.  Tasks count their documents by
`Table.group_by`, Spark merges the partial counts.  A second pass gives every document the counts of
its links: the `HEAVY` most frequent pairs (a table of fixed size) are looked up in the task, links of
all others are joined with the counts by Spark, which leaves no hot key.  Both passes align: that is
cheaper than to write the links.

Null and empty texts, and texts whose joined bytes differ on either side from a space and the text
(a literal U+2581, say), have no tokens: counts are zero and the hash column is ''.  Strings of special
tokens are plain text.  Rows with null or repeated identifiers are documents of their own; other
columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles, vocab
from .common import Workspace

#: Pairs that are looked up in the task, bytes of text that are aligned together, and aligned words a
#: task keeps for the next texts.
HEAVY, SLAB, WORDS = 1 << 16, 1 << 22, 1 << 19
#: Counted pairs a task holds before it gives them out.
_HELD = 1 << 20
_SHIFT = 32
#: White space (as Python has it) before or after a space, or at an end of the text.
_BESIDE_SPACE = r"^[\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}]$| [\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}] |^$"
_COMMA, _BAR, _SEMICOLON = (pa.scalar(c, pa.large_string()) for c in ",|;")


class Aligned(NamedTuple):
    """Texts aligned one by one; links of a text follow each other."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: pa.Array  # `a1,a2|b1;a3|b2,b3`
    pair: np.ndarray  # a << 32 | b, of each link


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _tokens(lists: list, names: pa.Array) -> tuple[pa.LargeListArray, pa.Array]:
    """The ids of each text, and its joined bytes."""
    ids = pa.array(lists, pa.large_list(pa.int64()))
    token = names.take(ids.flatten())
    start = np.frombuffer(token.buffers()[1], np.int64)[np.asarray(ids.offsets)]  # neighbours in one buffer
    return ids, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(start), token.buffers()[2]])


def _ends(ids: pa.LargeListArray, lengths: pa.Array, name: str) -> pa.Table:
    """(text, end, id, end again) of every token: a cumulative sum inside each text."""
    flat, text = pc.list_flatten(ids), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(lengths.take(flat))
    before = np.concatenate([[0], np.asarray(running)])[np.asarray(ids.offsets)[:-1]]
    end = pc.subtract(running, pa.array(before, pa.int64()).take(text))
    return pa.table({"text": text, "end": end, name: flat})


def align(texts: list[str], a_path: str, b_path: str) -> Aligned:
    """Align texts, each of them after a space; none is empty."""
    encode, model = vocab.byte_level(a_path).encode_ordinary, vocab.pieces(b_path)
    a_names, b_names = vocab.byte_tokens(a_path), vocab.piece_tokens(b_path)
    a, a_bytes = _tokens([encode(" " + t) for t in texts], a_names)
    b, b_bytes = _tokens(model.encode(texts, num_threads=1), b_names)
    raw = pa.array([b" " + t.encode() for t in texts], pa.large_binary())
    valid = pc.and_(pc.equal(a_bytes, raw), pc.equal(b_bytes, raw))
    empty = pa.scalar([], a.type)
    a, b = pc.if_else(valid, a, empty), pc.if_else(valid, b, empty)
    left, right = _ends(a, pc.binary_length(a_names), "a"), _ends(b, pc.binary_length(b_names), "b")
    ends = left.join(right, keys=["text", "end"], join_type="full outer", use_threads=False)
    ends = ends.sort_by([("text", "ascending"), ("end", "ascending")]).combine_chunks()
    both = np.asarray(pc.and_(ends["a"].is_valid(), ends["b"].is_valid()))
    pair_a, pair_b = (np.asarray(pc.fill_null_backward(ends[c].combine_chunks())) for c in "ab")
    text = np.asarray(ends["text"])
    n_groups = np.bincount(text[both], minlength=len(texts))
    return Aligned(
        np.asarray(valid), np.diff(np.asarray(a.offsets)), np.diff(np.asarray(b.offsets)), n_groups,
        np.bincount(text, minlength=len(texts)), _group_texts(ends, both, n_groups), pair_a.astype(np.int64) << _SHIFT | pair_b,
    )


def _group_texts(ends: pa.Table, both: np.ndarray, n_groups: np.ndarray) -> pa.Array:
    sides = []
    for name in "ab":
        ids = ends[name].combine_chunks()
        here = np.asarray(ids.is_valid())
        counted = np.cumsum(here)[both]  # ids up to the end of each group
        decimal = pc.drop_null(ids).cast(pa.large_string())
        sides.append(pc.binary_join(_lists(np.concatenate([[0], counted]), decimal), _COMMA))
    joined = pc.binary_join_element_wise(*sides, _BAR)
    return pc.binary_join(_lists(_offsets(n_groups), joined), _SEMICOLON)


class Slab(NamedTuple):
    """Some documents put together from the distinct words of their texts."""

    words: Aligned
    word: np.ndarray  # the words of all documents that have tokens, one after the other
    count: np.ndarray  # how many of them each document has

    def totals(self, per_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each document."""
        sums = np.concatenate([[0], np.cumsum(per_word[self.word])])
        at = _offsets(self.count)
        return sums[at[1:]] - sums[at[:-1]]

    def groups_sha256(self) -> list[str]:
        joined = pc.binary_join(_lists(_offsets(self.count), self.words.groups.take(pa.array(self.word))), _SEMICOLON)
        return [hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(joined, self.count.tolist(), strict=True)]

    def links(self) -> pa.Table:
        """(word, pair) of all links of the distinct words."""
        return pa.table({"word": np.repeat(np.arange(len(self.words.n_links)), self.words.n_links), "pair": self.words.pair})

    def by_document(self, links: pa.Table) -> pa.Table:
        """(document, pair, times) of links of the distinct words."""
        used = pa.table({"document": np.repeat(np.arange(len(self.count)), self.count), "word": self.word})
        often = used.group_by(["document", "word"], use_threads=False).aggregate([([], "count_all")])
        each = links.group_by(["word", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["word", "pair", "times"])
        met = often.join(each, keys="word", join_type="inner", use_threads=False)
        met = met.append_column("n", pc.multiply(met["times"], met["count_all"]))
        found = met.group_by(["document", "pair"], use_threads=False).aggregate([("n", "sum")])
        return found.rename_columns(["document", "pair", "times"])


def _merged(a: Aligned, b: Aligned) -> Aligned:
    join = lambda x, y: pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate([x, y])
    return Aligned(*map(join, a, b))


def _chosen(a: Aligned, which: np.ndarray) -> Aligned:
    n = a.n_links[which]
    begin = _offsets(a.n_links)[which]
    place = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    return Aligned(a.valid[which], a.n_a[which], a.n_b[which], a.n_groups[which], n, a.groups.take(pa.array(which)), a.pair[place])


class Words:
    """The words a task has aligned; it starts anew when they are many."""

    def __init__(self, a_path: str, b_path: str, most: int = WORDS):
        self.paths, self.most = (a_path, b_path), most
        self.numbers: dict[str, int] = {}
        self.aligned = align([], a_path, b_path)

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts, and how many each text has.  Texts in which white space is next to
        a space, or at either end, are cut by the general rule, the others at every space."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = np.asarray(pc.match_substring_regex(texts, _BESIDE_SPACE))
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        count = np.zeros(len(texts), np.int64)
        count[~odd] = np.diff(np.asarray(plain.offsets))
        other = [[w[1:] for w in vocab.WORD_START.split(" " + t)] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        count[odd] = [len(words) for words in other]
        if not odd.any():
            return plain.flatten(), count
        both = pa.concat_arrays([plain.flatten(), pa.array([w for words in other for w in words], pa.large_string())])
        back = np.argsort(np.concatenate([np.flatnonzero(~np.repeat(odd, count)), np.flatnonzero(np.repeat(odd, count))]))
        return both.take(pa.array(back)), count

    def slab(self, texts: pa.Array) -> Slab:
        if len(self.numbers) > self.most:
            self.numbers, self.aligned = {}, align([], *self.paths)
        words, count = self._split(texts)
        coded = words.dictionary_encode()
        known = len(self.numbers)
        number = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in coded.dictionary.to_pylist()], np.int64)
        self.aligned = _merged(self.aligned, align(list(islice(self.numbers, known, None)), *self.paths))
        used = _chosen(self.aligned, number)
        word = np.asarray(coded.indices).astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(~used.valid[word])])
        at = _offsets(count)
        whole = bad[at[1:]] == bad[at[:-1]]  # one word with other bytes takes all tokens from its document
        return Slab(used, word[np.repeat(whole, count)], np.where(whole, count, 0))

    def slabs(self, batch: pa.RecordBatch) -> Iterator[tuple[int, Slab]]:
        """The batch's texts in slabs, each with the number of its first row."""
        for lo, texts in shingles.pieces(batch["text"], SLAB):
            yield lo, self.slab(texts)


# ------------------------------------------------------------------------------------- in Spark


def _split(pair: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array((pair >> _SHIFT).astype(np.int32)), pa.array((pair & ((1 << _SHIFT) - 1)).astype(np.int32))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n): in how many documents a pair of ids is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            found = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return found.select(["pair", "n_sum"]).rename_columns(["pair", "n"])

        def out(found: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*_split(found["pair"].to_numpy()), found["n"].combine_chunks()], names=["a", "b", "n"])

        words = Words(a_path, b_path)
        for batch in batches:
            for _, part in words.slabs(batch):
                found = part.by_document(part.links()).group_by("pair", use_threads=False).aggregate([([], "count_all")])
                held.append(found.select(["pair", "count_all"]).rename_columns(["pair", "n"]))
                rows += len(found)
                if rows > 2 * _HELD:
                    whole = merged()
                    if len(whole) > _HELD:
                        yield out(whole)
                        held, rows = [], 0
                    else:
                        held, rows = [whole], len(whole)
        if held:
            yield out(merged())

    partial = docs.select("text").mapInArrow(count, "a int, b int, n bigint")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


_RESULT = (
    "row_id bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups_sha256 string, a int, b int, times bigint"
)
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _RESULT.split(", "))])


def _batch(n: int, **columns) -> pa.RecordBatch:
    made = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(made, schema=_ARROW)


def _describe(heavy: pa.Table, a_path: str, b_path: str) -> Callable:
    """Rows of documents with the sums over their frequent pairs, and rows (row_id, a, b, times) of
    their other links."""
    order = np.argsort(heavy["pair"].to_numpy())
    known, n, best = (heavy[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = Words(a_path, b_path)
        for batch in batches:
            for lo, part in aligned.slabs(batch):
                rows = batch.slice(lo, len(part.count))
                distinct, number = np.unique(part.words.pair, return_inverse=True)
                first = _offsets(part.words.n_links)
                at = np.searchsorted(known, distinct)
                at[at == len(known)] = 0
                hit = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
                of_pair = np.where(hit, n[at], 0) if len(known) else np.zeros(len(distinct), np.int64)
                is_best = hit & best[at] if len(known) else hit

                def per_word(values: np.ndarray, number=number, first=first) -> np.ndarray:
                    sums = np.concatenate([[0], np.cumsum(values[number].astype(np.int64))])
                    return sums[first[1:]] - sums[first[:-1]]

                words = part.words
                yield _batch(
                    len(rows), row_id=rows["row_id"], doc_id=rows["doc_id"], n_a=part.totals(words.n_a), n_b=part.totals(words.n_b),
                    n_groups=part.totals(words.n_groups), n_links=part.totals(words.n_links), n_best=part.totals(per_word(is_best)),
                    count_sum=part.totals(per_word(of_pair)), groups_sha256=part.groups_sha256(),
                )
                rare = ~hit[number]
                if rare.any():
                    other = part.by_document(part.links().filter(pa.array(rare)))
                    a, b = _split(other["pair"].to_numpy())
                    yield _batch(len(other), row_id=rows["row_id"].take(other["document"].combine_chunks()), a=a, b=b,
                                 times=other["times"].combine_chunks())

    return describe


def aligned_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """For every row of (doc_id, text): n_a, n_b, n_groups, n_links, n_best (links of the most frequent
    pairs of their A id), count_sum (of the pairs' counts over all links) and groups_sha256."""
    a_path, b_path = a_path or vocab.byte_file(), b_path or vocab.piece_file()
    work = Workspace(docs.sparkSession)
    counts = work.keep(pair_counts(docs, a_path, b_path))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row per id of A
    known = work.keep(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))
    top = known.orderBy(F.desc("n"), "a", "b").limit(heavy).toArrow()
    pair = pc.bit_wise_or(pc.shift_left(top["a"].cast(pa.int64()), _SHIFT), top["b"].cast(pa.int64()))
    describe = _describe(pa.table({"pair": pair, "n": top["n"], "best": top["best"]}).combine_chunks(), a_path, b_path)
    numbered = docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id())
    made = work.keep(numbered.select("row_id", "doc_id", "text").mapInArrow(describe, _RESULT))
    rest = made.filter(F.col("a").isNotNull()).select("row_id", "a", "b", "times").join(known, ["a", "b"])
    sums = rest.groupBy("row_id").agg(
        F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    rows = made.filter(F.col("a").isNull()).drop("a", "b", "times").join(sums, "row_id", "left")
    added = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).alias(own)
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256"
    )

"""Language identification by words first.

A word seen in training counts with its log frequency in each language.  An unseen word backs off
to its character n-grams, with marks at both ends: the longest length of which any n-gram is known
counts, with the mean log frequency of the known ones.  A text's score is the mean over its words.

The model holds every word and n-gram of a bounded sample of `TRAIN_DOCS` labelled documents per language
(of rows with one identifier, one), with its count in each language.

Null texts and texts without a letter are `und` with score 0; so is every text if there was nothing
to learn from.  Equal scores go to the language that sorts first."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT_FOLD, Workspace, fold, held_out

#: Labelled documents to learn from, about this many per language.
TRAIN_DOCS = 1_500
LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"
_ALPHA = 0.5
#: Words after which further ones no longer raise the confidence.
_FULL = 12
#: Words whose scores a Python worker remembers.
_REMEMBERED = 1 << 18
_SLICE = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # -> row of scores
    grams: dict[str, int]
    scores: np.ndarray  # rows x languages


# ------------------------------------------------------------------------------------ learning


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """The model of (doc_id, text, lang) rows outside the held-out fold with a language."""
    work = Workspace(docs.sparkSession)
    usable = (fold(F.col("doc_id")) != HELD_OUT_FOLD) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    learned = docs.filter(usable)
    sizes = work.keep(learned.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n")))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.lit(float(per_language << 20)) / F.col("_n")
    sample = learned.select("doc_id", "lang", "text").join(sizes, "lang").filter(drawn)
    one = F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("text"), "lang"))
    sample = sample.groupBy("doc_id").agg(one.alias("_one")).select("_one.*")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counted = work.keep(sample.select("lang", word.alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    words = counted.withColumn("length", F.lit(0)).unionByName(
        totals.select("lang", F.lit(None).cast("string").alias("item"), F.col("total").alias("n"), F.lit(0).alias("length"))
    )
    # Letter by letter, so that a run of any length takes time in proportion; the generator keeps the
    # letters from being split again for every n-gram.
    letters = F.regexp_extract_all(F.concat(F.lit("^"), F.col("item"), F.lit("$")), F.lit("(?s)."), F.lit(0))
    grams = counted.select("lang", "n", letters.alias("letters"), F.explode(F.array(*map(F.lit, LENGTHS))).alias("length"))
    places = F.sequence(F.lit(1), F.size("letters") - F.col("length") + 1)
    gram = F.transform(places, lambda i: F.array_join(F.slice("letters", i, F.col("length")), ""))
    grams = (
        grams.filter(F.size("letters") >= F.col("length"))
        .select("lang", "n", "length", F.explode(gram).alias("item"))
        .groupBy("lang", "length", "item")
        .agg(F.sum("n").alias("n"))
    )
    grams = work.keep(grams)
    gram_totals = grams.groupBy("lang", "length").agg(F.sum("n").alias("n")).withColumn("item", F.lit(None).cast("string"))
    rows = words.unionByName(grams).unionByName(gram_totals).toArrow()
    return build(rows)


def build(rows: pa.Table) -> Model:
    """Rows (lang, length, item, n); length 0 are words, a null item has the total."""
    lang, length, item, n = (rows[c].to_pylist() for c in ("lang", "length", "item", "n"))
    languages = sorted(set(lang))
    column = {x: k for k, x in enumerate(languages)}
    totals = np.zeros((max(LENGTHS) + 1, len(languages)))
    tables: tuple[dict, dict] = ({}, {})
    for x, size, what, count in zip(lang, length, item, n, strict=True):
        if what is None:
            totals[size, column[x]] = count
        else:
            tables[size > 0].setdefault((what, size), {})[column[x]] = count
    words, grams, scores = {}, {}, []
    kinds = [len({k for t in tables for k in t if k[1] == size}) for size in range(max(LENGTHS) + 1)]
    for table, index in zip(tables, (words, grams), strict=True):
        for (what, size), counts in sorted(table.items()):
            index[what] = len(scores)
            own = np.zeros(len(languages))
            own[list(counts)] = list(counts.values())
            scores.append(np.log((own + _ALPHA) / (totals[size] + _ALPHA * max(1, kinds[size]))))
    return Model(languages, words, grams, np.array(scores, np.float32).reshape(len(scores), len(languages)))


# ------------------------------------------------------------------------------------- scoring


class Scorer(dict):
    """word -> row in `table`; a dictionary, so that known words need no Python step each."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.table = np.zeros((1 << 12, len(self.model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = self._score(word)
        self[word] = row
        return row

    def _score(self, word: str) -> np.ndarray | float:
        model = self.model
        if (known := model.words.get(word)) is not None:
            return model.scores[known]
        marked = f"^{word}$"
        for size in LENGTHS:
            rows = [r for i in range(len(marked) - size + 1) if (r := model.grams.get(marked[i : i + size])) is not None]
            if rows:
                return model.scores[rows].mean(0)
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not len(self.model.languages):
            return UNKNOWN, 0.0
        total, n, letter = np.zeros(len(self.model.languages)), 0, False
        for part in _slices(text):
            words = _LETTERS.findall(part.lower())
            if words:
                rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
                total += self.table[rows].sum(0, np.float64)
                n += len(words)
                letter = letter or words[0][0].isalpha() or any(c.isalpha() for w in words for c in w)
            if len(self) > _REMEMBERED:
                self.forget()
        if not letter:
            return UNKNOWN, 0.0
        scaled = total / n * min(n, _FULL)
        share = np.exp(scaled - scaled.max())
        best = int(share.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


def _slices(text: str):
    """Pieces of a very long text, cut at spaces, so that its words are never all held at once."""
    lo = 0
    while lo < len(text):
        hi = len(text)
        if hi - lo > _SLICE:
            hi = text.rfind(" ", lo, lo + _SLICE) + 1
            hi = hi if hi > lo else lo + _SLICE
        yield text[lo:hi]
        lo = hi


_current: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of this model, with the words it has met in earlier batches."""
    if not _current or _current[0].model is not model:
        _current[:] = [Scorer(model)]
    return _current[0]


def predicted(model: Broadcast, text: Column) -> Column:
    """Struct (lang_pred, score) for the text of each row."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        scorer = _scorer(model.value)
        found = [scorer.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
            ["lang_pred", "score"],
        )

    return predict(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of (doc_id, text, lang)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(model, F.col("text")).alias("_p")
    ).select("doc_id", "held_out", "_p.lang_pred", "_p.score")

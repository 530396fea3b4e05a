"""Feature-hash embedding inside one row: tokens, 512 buckets, unit length.  No shuffle.

There are two equal forms.  :func:`hash_embed` and :func:`bucket_weights` are Arrow UDFs: most tokens
are repeats, and a task remembers their buckets, which a SQL expression cannot; they measured four
times faster than :func:`hash_embed_expr` and :func:`bucket_weights_expr`, the forms built from SQL
functions, which need no Python worker.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalogues as cat
from .regex import let_sql, sql_literal

# Letters, digits and underscore in any script.
_TOKEN = r"[\p{L}\p{N}_]+"
# Nine bits of a digest as a three-character code: parity of one hex digit, then two hex digits.
_CODES = ", ".join(f"'{i:03x}'" for i in range(cat.EMBEDDING_DIM))


def build_document(blocks: str, raw: str) -> Column:
    """The text that is embedded: leading prompt blocks, then the head of the raw text."""
    head = f"substring({raw}, 1, {cat.DOCUMENT_RAW_CHARS})"
    return F.expr(
        f"substring(array_join(concat(slice({blocks}, 1, {cat.DOCUMENT_BLOCKS}),"
        f" CASE WHEN {raw} <> '' THEN array({head}) ELSE cast(array() AS array<string>) END),"
        f" '\\n\\n'), 1, {cat.DOCUMENT_CHARS})"
    )


def tokenize_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {sql_literal(_TOKEN)}, 0)"


def tokenize(text: str) -> Column:
    return F.expr(tokenize_sql(text))


def _codes_sql(tokens: str, digest: str) -> str:
    tails = f"transform({tokens}, t -> right({digest}(t), 3))"
    return (
        f"transform({tails}, d -> concat(translate(left(d, 1), '0123456789abcdef',"
        " '0101010101010101'), right(d, 2)))"
    )


def bucket_weights_sql(text: str) -> str:
    """Dense weights: per token 1.0 at its first hash, 0.5 at its second.

    The bucket codes are sorted and joined, and one regex pass cuts the string into runs of equal
    codes; every code is added once so that all buckets have a run.  The cost stays linear."""
    codes = (
        f"array_join(sort_array(concat(first, first, {_codes_sql('tokens', 'sha1')},"
        f" array({_CODES}))), '')"
    )
    runs = f"regexp_extract_all({codes}, {sql_literal(r'(.{3})' + chr(92) + '1*')}, 0)"
    weights = f"transform({runs}, r -> (char_length(r) / 3D - 1D) * 0.5D)"
    return let_sql(
        "tokens", tokenize_sql(text), let_sql("first", _codes_sql("tokens", "md5"), weights)
    )


def bucket_weights_expr(text: str) -> Column:
    return F.expr(bucket_weights_sql(text))


def l2_normalize(weights: str) -> Column:
    """Unit vector as floats; the zero vector stays zero."""
    norm = f"sqrt(aggregate({weights}, 0D, (acc, w) -> acc + w * w))"
    return F.expr(
        let_sql("norm", norm, f"transform({weights}, w -> float(CASE WHEN norm > 0 THEN w / norm ELSE 0D END))")
    )


def hash_embed_expr(text: str) -> Column:
    """Embedding of a text by SQL functions: `array<float>` of fixed width and unit length."""
    norm = "sqrt(aggregate(ws, 0D, (acc, w) -> acc + w * w))"
    unit = let_sql("norm", norm, "transform(ws, w -> float(CASE WHEN norm > 0 THEN w / norm ELSE 0D END))")
    return F.expr(let_sql("ws", bucket_weights_sql(text), unit))


def _arrow_embedder(dim: int, unit: bool, remembered: int = 1 << 18):
    """The UDF: unit vectors as floats, zero for a null text, or the weights themselves as doubles, null
    for one; all it needs is nested here, so executors do not have to import this package."""

    class Buckets(dict):
        """Both buckets of a token as one number.  When it grows too large it is set aside and begun again,
        and what was set aside before is forgotten: frequent tokens are taken over, never hashed again."""

        def __init__(self):
            self.aside: dict[str, int] = {}

        def __missing__(self, token: str) -> int:
            both = self.aside.get(token)
            if both is None:
                data = token.encode()
                first, second = hashlib.md5(data).digest(), hashlib.sha1(data).digest()
                # The last two bytes decide: the width is a power of two, of 65,536 at most.
                both = (first[-2] << 8 | first[-1]) % dim * dim + (second[-2] << 8 | second[-1]) % dim
            if len(self) >= remembered:
                self.aside = dict(self)
                self.clear()
            self[token] = both
            return both

    if dim & dim - 1 or dim > 1 << 16:
        raise ValueError(f"width {dim} is no power of two up to 65,536")
    buckets = Buckets()
    word = re.compile(r"\w+")
    apart = {c: " " for c in range(128) if not word.match(chr(c))}

    def words(text: str) -> list[str]:
        """In ASCII a cut at blanks finds the same words sooner."""
        return text.translate(apart).split() if text.isascii() else word.findall(text)

    def embed(texts: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), dim), dtype=np.float32 if unit else np.float64)
        for row, text in enumerate(texts.to_pylist()):
            tokens = words((text or "").lower())
            if tokens:
                pairs = np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens))
                weights = np.bincount(pairs // dim, minlength=dim) + 0.5 * np.bincount(pairs % dim, minlength=dim)
                rows[row] = weights / np.linalg.norm(weights) if unit else weights
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()), mask=None if unit else texts.is_null())

    return F.arrow_udf(embed, T.ArrayType(T.FloatType() if unit else T.DoubleType()))


_ARROW_EMBEDDER = _arrow_embedder(cat.EMBEDDING_DIM, True)
_ARROW_WEIGHTS = _arrow_embedder(cat.EMBEDDING_DIM, False)


def bucket_weights(text: str) -> Column:
    """Dense weights of a text, `array<double>`: per token 1.0 at its first hash, 0.5 at its second."""
    return _ARROW_WEIGHTS(F.expr(text))


def hash_embed(text: str) -> Column:
    """Embedding of a text: `array<float>` of fixed width and unit length."""
    return _ARROW_EMBEDDER(F.expr(text))


def sparse(vector: str) -> Column:
    """Non-zero entries as (bucket, weight), in bucket order."""
    return F.expr(
        f"filter(transform({vector}, (w, i) -> named_struct('bucket', i, 'weight', double(w))),"
        " e -> e.weight <> 0)"
    )


def distance_to_sparse(vector: str, query: str) -> Column:
    """Cosine distance of a unit vector to a sparse unit query: touches the query's buckets only."""
    return F.expr(
        f"1D - aggregate({query}, 0D, (acc, e) -> acc + double({vector}[e.bucket]) * e.weight)"
    )


def cosine_distance(left: str, right: str) -> Column:
    """Cosine distance of two dense vectors; 1 if one of them is zero."""

    def square(v: str) -> str:
        return f"aggregate({v}, 0D, (acc, x) -> acc + double(x) * double(x))"

    dot = (
        f"aggregate(zip_with({left}, {right}, (a, b) -> double(a) * double(b)), 0D, (acc, x) -> acc + x)"
    )
    return F.expr(
        let_sql("scale", f"sqrt({square(left)}) * sqrt({square(right)})",
                f"CASE WHEN scale > 0 THEN 1D - {dot} / scale ELSE 1D END")
    )

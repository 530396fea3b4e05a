"""Public tokenizers by file: ids of whole texts, and the bytes of every id.

A byte-level file of the `tokenizers` library is run by tiktoken, which gives the same ids several
times faster: its ranks are the file's ids, which holds where every merge makes the next id (checked
when the file is read).  The tests compare the ids with the named library."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SLICE = 1 << 20
#: No token of either kind reaches over the place between a character that is no white space and a
#: space that another such character follows.
WORD_START = re.compile(r"(?<=\S)(?= \S)")


def byte_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes are
    themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def byte_level(path: str):
    """The file's tokenizer as a tiktoken encoding; its added tokens are the special ones."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    added = {t["content"]: t["id"] for t in whole["added_tokens"]}
    letters = _byte_letters()
    vocabulary = whole["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in added}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in whole["model"]["merges"]]
    if made != sorted(made) or sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"{path}: ids do not follow the order of the merges")
    return tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=4)
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def slices(text: str, most: int | None = None):
    """A very long text in parts that tokenize independently; each later one begins with a space."""
    lo, most = 0, most or _SLICE
    while lo < len(text):
        cut = WORD_START.search(text, lo + most) if len(text) - lo > most else None
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def byte_ids(encoding, text: str | None, added: bool = True) -> np.ndarray:
    """Ids of a whole text.  The strings of added tokens in it become these tokens, as the library
    has it by default; without `added` they are ordinary text."""
    encode = (lambda part: encoding.encode(part, allowed_special="all")) if added else encoding.encode_ordinary
    return np.concatenate([np.zeros(0, np.int64), *(np.array(encode(part), np.int64) for part in slices(text or ""))])


@lru_cache(maxsize=4)
def byte_tokens(path: str) -> pa.Array:
    """The bytes of each id of a byte-level file."""
    encoding = byte_level(path)
    return pa.array([encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)], pa.large_binary())


@lru_cache(maxsize=4)
def piece_tokens(path: str) -> pa.Array:
    """The bytes of each id of a piece model: U+2581 is a space, <0xHH> a byte."""
    model = pieces(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return pa.array(raw, pa.large_binary())

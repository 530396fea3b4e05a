"""Pivot-table clustering, the SimHash trie join and token alignment against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwork.llm import alignment, pivots, simhash, vocab
from siftwork.llm.common import Workspace

from .conftest import words

# ------------------------------------------------------------------------------ clustering


def brute_clusters(rows, clusters, rounds, width, seed=3):
    usable = lambda x: x is not None and len(x) == width and all(v is not None and np.isfinite(v) for v in x)
    kept = [(i, np.clip(np.floor(1024 * np.array(x, float)), -(2**27), 2**27).astype(np.int64)) for i, x in rows if usable(x)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].astype("<i4").tobytes())
    centres = [v for _, v in sorted(kept, key=rank)[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            away = [sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((away.index(min(away)), min(away)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (k, _) in zip(kept, found, strict=True) if k == c]
            if own:
                centres[c] = np.array([sum(map(int, x)) // len(own) for x in zip(*own, strict=True)])
    found = assign()
    inertia = Counter()
    for c, d in found:
        inertia[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()
    whole = sum(inertia.values())
    return [(i, c, d, inertia[c], whole, name(c)) for (i, _), (c, d) in zip(kept, found, strict=True)]


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_agree_with_brute_force(spark, kind):
    rng = random.Random(11)
    middle = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(middle)]) for i in range(400)]
    rows += [(500 + i, [0.25] * 6) for i in range(60)]  # ties
    rows += [(7, rows[7][1]), (None, [0.5] * 6), (None, [0.5] * 6), (900, None), (901, []), (902, [1.0] * 5), (903, [None] * 6)]
    rows += [(904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [1.0] * 5 + [None]), (907, [1e30] * 6), (908, [-1e30] * 6)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(5)
    df = df.withColumns({n: F.lit("!") for n in ("v", "pivots", "cluster", "distance", "x")})  # names used inside
    for clusters, rounds in ((8, 10), (3, 2), (1, 1)):
        got = pivots.cluster(df, clusters=clusters, rounds=rounds, width=6)
        assert by_text(got.collect()) == by_text(brute_clusters(rows, clusters, rounds, 6))


def test_few_vectors_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    got = pivots.cluster(spark.createDataFrame(rows, schema), width=2).collect()
    assert [(r.distance, r.inertia) for r in got] == [(0, 0)] * 2 and {r.cluster for r in got} == {0, 1}
    for none in ([], [(1, [1.0])]):
        empty = pivots.cluster(spark.createDataFrame(none, schema), width=2)
        assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_pivots_spare_exact_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (8, 16))
    rows = (centres[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 16))).astype(np.int64)
    chosen = pivots.choose_pivots(rows[:200], 12)
    table = pivots.euclidean(rows, chosen).astype("<f4").astype(float)
    cluster, distance, work = pivots.nearest(rows, table, centres, pivots.euclidean(centres, chosen))
    away = ((rows[:, None] - centres[None]) ** 2).sum(2)
    assert (cluster == away.argmin(1)).all() and (distance == away.min(1)).all()
    assert work < 0.4 * away.size


# ---------------------------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    found = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(values, budget):
    """For each value the position of the first one of its group."""
    above = list(range(len(values)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget and top(i) != top(j):
                above[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(values))]


def test_fingerprints_of_texts(odd_docs, monkeypatch):
    rng = random.Random(12)
    texts = [r.text for r in odd_docs.collect()] + [words(rng, rng.randrange(0, 90), 8) for _ in range(60)]
    texts += ["One\ttwo", "ONE two\x0bthree\x1cfour", "É é Å", "a b", "a b c"]
    want = [brute_fingerprint(t) for t in texts]
    assert simhash.fingerprints(pa.array(texts)).tolist() == want
    monkeypatch.setattr(simhash, "_PIECE", 16)  # long texts go piece by piece
    assert simhash.fingerprints(pa.array(texts)).tolist() == want


def random_fingerprints(rng, n):
    """Some far apart, some in a chain, some in one dense ball."""
    base = [rng.getrandbits(64) for _ in range(n)] + [0, (1 << 64) - 1, 1 << 63]
    ball = rng.getrandbits(64)
    base += [ball ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & ((1 << 64) - 1) for _ in range(n)]
    chain = rng.getrandbits(64)
    for _ in range(n):
        chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
        base.append(chain)
    return sorted(set(base))


@pytest.mark.parametrize(("budget", "unit"), [(3, 1 << 15), (3, 12), (2, 6), (5, 20)])
def test_trie_join_loses_no_link(spark, budget, unit):
    rng = random.Random(budget * 100 + unit)
    values = random_fingerprints(rng, 60)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint bigint").repartition(4)
    work = Workspace(spark)
    found = work.keep(simhash.near_edges(df, work, budget, unit)).collect()
    place = {signed(v): i for i, v in enumerate(values)}
    least = least_reachable(values, budget)
    joined = simhash.Groups(len(values))
    joined.link(*(np.array([place[r[c]] for r in found], np.int64) for c in "ab"))
    assert joined.least.tolist() == least


def test_units_give_fewer_edges_than_rows():
    rng = random.Random(13)
    dense = sorted({sum(1 << rng.randrange(20) for _ in range(3)) for _ in range(3000)})  # nearly all linked
    n = len(dense)
    same = lambda x: pa.array([x] * n, pa.int64())
    v = pa.array(dense, pa.int64())
    rows = pa.table({"part": same(0), "depth": same(16), "pa": same(0), "pb": same(0), "value": v, "fingerprint": v})
    a, b = simhash.link_units(rows, 3)
    assert len(a) == n - len(set(least_reachable(dense, 3)))


def test_near_duplicates(spark, odd_docs, no_docs, clashing):
    rng = random.Random(14)
    own = [words(rng, 150) for _ in range(30)]
    texts = own + [t.replace(" ", "  ", 1).upper() for t in own[:10]] + [t + " more" for t in own[:20]] + ["", None, "x y", "X Y"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    prints = [brute_fingerprint(t) for t in texts]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    least = least_reachable([prints[i] for i in order], 3)
    want = {rows[i][0]: (f"{prints[i]:016x}", rows[order[least[k]]][0]) for k, i in enumerate(order)}
    for unit in (simhash.UNIT, 4):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, unit=unit).collect()}
        assert got == want
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == 12
    of = lambda i: [(r.fingerprint, r.component_id) for r in found if r.doc_id == i]
    assert of(2) == of(3) == of(4) == [("0" * 16, 2)] and len(of(1)) == 2 and of(5)[0][1] == of(6)[0][1] == 5
    assert [c for _, c in of(None)] == [None, None]
    assert by_text(simhash.near_duplicates(clashing).collect()) == by_text(found)
    assert simhash.near_duplicates(no_docs).count() == 0


# ------------------------------------------------------------------------- token alignment


@pytest.fixture(scope="module")
def named():
    """The two tokenizers by their own libraries, and the bytes of every id."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    raw_a = {i: bytes(letter[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(32000)))]
    return a, b, raw_a, raw_b


def brute_alignment(texts, named):
    a, b, raw_a, raw_b = named
    out, links = [], []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [raw_a[i] for i in ids_a], [raw_b[i] for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for own in (bytes_a, bytes_b):
            ends = np.cumsum([len(x) for x in own]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        links.append([(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e])
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        inside = lambda ids, own, lo, hi: ",".join(str(i) for i, (_, e) in zip(ids, own, strict=True) if lo < e <= hi)
        groups = [inside(ids_a, spans[0], lo, hi) + "|" + inside(ids_b, spans[1], lo, hi) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        out.append((len(ids_a), len(ids_b), len(groups), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(*o[:4], sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), o[4]) for o, own in zip(out, links, strict=True)]


TEXTS = [
    None, "", " ", "one", " lead", "trail ", "two  spaces", "a\nb", "a \n b\tc", "x <|endoftext|> y <s> </s> <unk>", "▁", "a ▁b c", "é😀 ñ ß",
    "中文 字 かな", "don't we'll", "e\xa0f   g", "\x00\x1c \x85 z", "tab\t tab", "x" * 3000, "<0x41> <0x0A>", "1234567 12 ٣٤", "a  ", "  ",
    "café ﬁ Å", "​ ﻿ ok",
]


def test_alignment_agrees_with_brute_force(spark, named, monkeypatch):
    rng = random.Random(15)
    alphabet = ["the", " the", " ", "  ", "\n", "é", "ß", "tion", "ing ", "中", "▁", "<|endoftext|>", "x1", "'s", "\t", "　", "😀"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += [words(rng, rng.randrange(1, 40), 30) for _ in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    df = df.withColumns({n: F.lit("!") for n in ("row_id", "a", "b", "n", "times", "pair")})  # names used inside
    want = brute_alignment(texts, named)
    for heavy in (alignment.HEAVY, 20, 0):
        got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned_documents(df, heavy=heavy).collect()}
        assert [got[i] for i, _ in rows] == [(*w[:4], w[4], w[5], w[6]) for w in want]


def test_words_are_kept_within_a_bound(named):
    rng = random.Random(16)
    texts = [words(rng, 30) for _ in range(50)]
    made = alignment.Words(vocab.byte_file(), vocab.piece_file(), most=40)
    for lo in range(0, 50, 5):
        part = made.slab(pa.array(texts[lo : lo + 5]))
        want = brute_alignment(texts[lo : lo + 5], named)
        assert part.totals(part.words.n_links).tolist() == [w[3] for w in want] and part.groups_sha256() == [w[6] for w in want]
        assert len(made.numbers) <= 40 + 150


def test_alignment_of_odd_rows(odd_docs, no_docs):
    rows = alignment.aligned_documents(odd_docs).collect()
    assert len(rows) == 12 and all(r.n_groups <= min(r.n_a, r.n_b) and r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)
    assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    assert [tuple(r)[1:] for r in rows if r.doc_id in (2, 3)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert alignment.aligned_documents(no_docs).count() == 0


def test_slices_give_the_ids_of_the_whole(named):
    rng = random.Random(17)
    encoding = vocab.byte_level(vocab.byte_file())
    for text in [*filter(None, TEXTS), words(rng, 200)]:
        parts = list(vocab.slices(text, 5))
        assert "".join(parts) == text
        assert sum((encoding.encode_ordinary(p) for p in parts), []) == named[0].encode(text, add_special_tokens=False).ids
        assert vocab.byte_ids(encoding, text, added=False).tolist() == named[0].encode(text, add_special_tokens=False).ids

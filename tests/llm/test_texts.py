"""Operators that work on one text: shingles, fingerprints, outliers, classifier, language."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwork.llm import language, outliers, quality, shingles, sketches

from .conftest import DOCS, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(texts, size, lower=False):
    return [s.tolist() for s in shingles.shingle_sets(pa.array(texts, pa.string()), size, lower)]


def test_shingles_agree_with_word_tuples(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "one two", "A b\tC  d", "a B c d", "e\xa0f g h", "z" * 5000 + " q r s"]
    texts += [words(rng, rng.randrange(1, 60), 12) for _ in range(60)]
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(shingles, "_CHUNK", chunk)
        for size in (1, 3, 5):
            got = sets_of(texts, size, lower=True)
            seen, back = {}, {}
            for t, own in zip(texts, got, strict=True):
                w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
                want = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
                assert len(own) == len(want) and own == sorted(set(own))
                seen[frozenset(want)] = own
                back[tuple(own)] = frozenset(want)
            assert all(back[tuple(own)] == want for want, own in seen.items())
    assert sets_of(["A b c"], 3) != sets_of(["a b c"], 3)


def test_shingles_in_pieces_are_the_same(monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(0, 40)) for _ in range(50)]
    whole = sets_of(texts, 5)
    monkeypatch.setattr(shingles, "pieces", lambda t, most=0: ((i, t.slice(i, 3)) for i in range(0, len(t), 3)))
    assert sets_of(texts, 5) == whole


def test_fingerprints():
    rng = random.Random(3)
    a, b = words(rng, 4000), words(rng, 4000)
    of = lambda t: next(sketches.fingerprints(pa.array([t])))
    half = of(a[: len(a) // 2])
    assert sketches.likeness(of(a), of(a)) == 1 and sketches.likeness(of(a), of(b)) < 0.01
    assert sketches.containment(half, of(a)) > 0.97 and 0.4 < sketches.containment(of(a), half) < 0.6
    both = sketches.merge(of(a), of(b))
    assert sketches.containment(of(a), both) > 0.99 and abs(both[0] - 7992) < 200
    for text in (a, "few words", "", None):
        n, check, kept = sketches.decode(sketches.encode(of(text)))
        want = of(text)
        assert (n, check) == want[:2] and kept.tolist() == want[2].tolist()
    assert sketches.encode(of(None)) == sketches.encode(of("  ")) == "0.0."
    assert sketches.likeness(of("one two"), of("three four")) == 0 and sketches.likeness(of(""), of(None)) == 1


def test_short_near_copies_are_seen():
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(30, 50)) for _ in range(300)]
    copies = [" ".join("changed" if i == 4 else w for i, w in enumerate(t.split())) for t in texts]
    sets = [list(shingles.shingle_sets(pa.array(x), 5)) for x in (texts, copies)]
    exact = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(*sets, strict=True)]
    got = [sketches.likeness(sketches.sketch_of(a), sketches.sketch_of(b)) for a, b in zip(*sets, strict=True)]
    assert np.mean(np.abs(np.array(got) - exact)) < 0.15 and got.count(0) <= 3


def neighbours(rows):
    """(text, edited text) by brute force for rows with distinct identifiers."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + u[:half]


def test_comparison_along_the_order(spark):
    rng = random.Random(4)
    rows = [(i * 7 - 20, words(rng, rng.randrange(1, 80)) + "é😀") for i in range(40)] + [(None, "no id"), (900, None), (901, "")]
    for parts, some in ((1, rows), (7, rows), (3, rows[:1]), (3, rows[:2])):
        df = spark.createDataFrame(some, "doc_id bigint, text string").repartition(parts)
        found = sketches.compare_with_next(df, part=sketches.PART if parts == 1 else 4).collect()
        got = {r.doc_id: r for r in found}
        assert len(got) == len(found) == len(some)
        for i, text, edited in neighbours(some):
            assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            prints = [sketches.encode(s) for s in sketches.fingerprints(pa.array([text, edited]))]
            assert [got[i].fingerprint, got[i].edited_fingerprint] == prints


def plain_sketch(text, scale):
    """The sketch as its definition has it: all shingle hashes below a fraction of the range."""
    w = WORD.findall(text)
    found = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())
    hashes = {int(next(shingles.shingle_sets(pa.array([s]), 5))[0]) for s in found}
    kept = sorted(h for h in hashes if h <= (2**64 - 1) // scale)
    return len(hashes), [h >> (64 - 32 - scale.bit_length() + 1) for h in kept]


def test_fingerprints_are_plain_sketches():
    rng = random.Random(21)
    for text in ["", "one two", words(rng, 5), words(rng, 400), words(rng, 300, 3)]:
        for scale in (1, 4, 16):
            n, _, kept = sketches.decode(sketches.encode(next(sketches.fingerprints(pa.array([text]), scale=scale))))
            assert (n, kept.tolist()) == plain_sketch(text, scale)


def test_one_identifier_may_hold_most_rows(spark):
    rng = random.Random(22)
    rows = [(5, words(rng, 20)) for _ in range(60)] + [(i, words(rng, 9)) for i in range(9)] + [(5, "same")] * 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    found = sketches.compare_with_next(df, part=4).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    prints = Counter(r.fingerprint for r in found)
    assert max(prints.values()) == 20
    one = sketches.compare_with_next(df, part=1000).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, one))


def test_comparison_of_odd_rows(odd_docs, no_docs):
    rows = sketches.compare_with_next(odd_docs).collect()
    assert len(rows) == 12 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert sketches.compare_with_next(no_docs).count() == 0
    assert sketches.with_fingerprint(odd_docs).columns[-1] == "fingerprint"


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, odd_docs):
    rng = random.Random(6)
    texts = [r.text for r in odd_docs.collect()]
    texts += ["a a a", "a a a a", "a b c a b c", "a b c d a b c x a b", "x\ny\nx\n \n \nx ", "# a # a # a |<>", "a b c d", "é é é é"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in outliers.base_statistics(df).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_outliers_are_found_and_clean_documents_kept(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        text = words(rng, rng.randrange(60, 400))
        if i % 20 == 0:  # many symbols
            text = " ".join(w + rng.choice(["###", "$$$", "|"]) for w in text.split())
        if i % 33 == 1:
            text = "too short"
        rows.append((i, text, ("en", "fr", None)[i % 3], f"s{i % 2}" if i % 5 else None, None))
    got = {r.doc_id: r for r in outliers.verdicts(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 600
    for i, r in got.items():
        bad = i % 20 == 0 or i % 33 == 1
        assert r.base_failed == (i % 33 == 1) and r.kept == (not bad), (i, r)


def test_covariance_determinant_resists_a_cluster(spark, tmp_path):
    """A fifth of the rows lie far away; the estimate is that of the others."""
    from siftwork.llm.common import Workspace

    rng = np.random.default_rng(8)
    clean = rng.normal(size=(800, 5)) * [1, 2, 1, 1, 3] + 5
    far = rng.normal(size=(200, 5)) * 0.1 + 60
    x = [(1, *map(float, r)) for r in np.concatenate([clean, far])]
    rows = spark.createDataFrame(x, "group bigint, x0 double, x1 double, x2 double, x3 double, x4 double")
    e = outliers.estimates(rows, Workspace(spark)).first()
    assert np.allclose([e[f"m{i}"] for i in range(5)], clean.mean(0), atol=0.4)
    judged = rows.join(spark.createDataFrame([e]).drop("n"), "group").select("x0", outliers.distance().alias("d")).collect()
    assert all((r.d > outliers.CUT) == (r.x0 > 30) for r in judged)


def brute_estimate(x):
    """The reweighted minimum covariance determinant of rows, step by step as the module says."""
    floors = np.array(list(outliers.FLOORS.values()))
    at = lambda v, p: np.sort(v, axis=0)[max(0, int(np.ceil(p * len(v))) - 1)]
    moments = lambda v: (v.mean(0), (v.T @ v) / len(v) - np.outer(v.mean(0), v.mean(0)) + np.diag(floors**2))

    def away(v, e):
        d = v - e[0]
        return np.einsum("ij,ij->i", d @ np.linalg.inv(e[1]), d)

    def nearest(v, d):
        return v[d <= at(d, outliers.CORE)]

    q = [at(x, p) for p in (0.25, 0.5, 0.75)]
    z = (x - q[1]) / np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + floors**2)
    norm = np.sqrt((z**2).sum(1))
    signs = np.where(norm[:, None] > 0, z / np.where(norm > 0, norm, 1)[:, None], 0)
    found = []
    for d in (norm, away(z, moments(signs))):
        e, falls = moments(nearest(x, d)), True
        while falls:
            after = moments(nearest(x, away(x, e)))
            falls = np.linalg.slogdet(e[1])[1] - np.linalg.slogdet(after[1])[1] > outliers.SETTLED
            e = after
        found.append((np.linalg.slogdet(e[1])[1], e))
    e = min(found, key=lambda f: f[0])[1]
    d = away(x, e)
    return away(x, moments(x[d <= outliers._INNER * max(1.0, at(d, 0.5) / outliers._MEDIAN)]))


def statistics_vector(r):
    n, chars = max(r.n_words, 1), max(r.word_chars, 1)
    return [np.log(n), np.log(chars / n), np.log1p(100 * r.n_symbols / chars), np.sqrt(10 * r.n_dup_lines / n), np.sqrt(r.n_repeat_words / n)]


def test_verdicts_against_brute_force(spark):
    rng = random.Random(23)
    rows = []
    for i in range(460):
        text = words(rng, rng.randrange(60, 300), rng.choice([400, 400, 60]))
        if i % 9 == 0:
            text = text.replace(" ", rng.choice([" # ", " | ", "\n"]), rng.randrange(40))
        rows.append((i, text, *(("en", "a"), ("en", "b"), ("fr", "a"), ("xx", f"s{i}"))[min(3, i % 7 % 4 if i < 430 else 3)], None))
    got = {r.doc_id: r for r in outliers.verdicts(spark.createDataFrame(rows, DOCS)).collect()}
    x = {i: statistics_vector(r) for i, r in got.items() if not r.base_failed}
    pools = {}
    for i, _, lang, source, _ in rows:
        if i in x:
            pools.setdefault((lang, source), []).append(i)
    small = {k: v for k, v in pools.items() if len(v) < outliers.LEAST}
    of_language = {}
    for (lang, _), own in small.items():
        of_language.setdefault(lang, []).extend(own)
    judged = [v for k, v in pools.items() if k not in small] + [v for v in of_language.values() if len(v) >= outliers.LEAST]
    rest = [i for v in of_language.values() if len(v) < outliers.LEAST for i in v]
    assert judged and rest
    want = {}
    for own in judged:
        want |= dict(zip(own, brute_estimate(np.array([x[i] for i in own])), strict=True))
    every = sorted(x)
    whole = dict(zip(every, brute_estimate(np.array([x[i] for i in every])), strict=True))
    want |= {i: whole[i] for i in rest}
    assert set(want) == set(x)
    assert all(got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-9) and got[i].kept == (d <= outliers.CUT) for i, d in want.items())


def test_outliers_of_odd_rows(odd_docs, no_docs):
    rows = outliers.verdicts(odd_docs).collect()
    assert len(rows) == 12 and all(r.base_failed for r in rows if r.n_words < 50)
    assert outliers.verdicts(no_docs).count() == 0


def test_tree_traversal_and_training():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5) | (x[:, 5] > 1.5)).astype(float)
    trees = quality.train(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row, t):
        k = 0
        while k < trees.feature.shape[1]:
            k = 2 * k + 1 + (row[trees.feature[t, k]] > trees.threshold[t, k])
        return trees.value[t, k - trees.feature.shape[1]]

    for row in x[:20]:
        margin = trees.base + sum(walk(row, t) for t in range(len(trees.feature)))
        assert trees.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))
    again = quality.train(x[:2000], y[:2000])
    assert (again.threshold == trees.threshold).all() and (again.value == trees.value).all()


def test_classifier(spark, odd_docs, no_docs, no_labels, clashing):
    rng = random.Random(10)
    rows = [(i, words(rng, 80) if i % 3 else "junk | " * rng.randrange(5, 60), "en", "a", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), 0) for i in range(600)] + [(3, 0, 0), (None, 1, 0), (4, None, 0), (10**9, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == int(i % 3 > 0) == int(r.score >= 0.3) for i, r in got.items())
    odd = quality.classify(odd_docs, labels).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality.classify(odd_docs, no_labels).collect()} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0
    kept = quality.accepted(clashing, no_labels)
    assert kept.columns == clashing.columns and kept.count() == 12


def test_language(spark, odd_docs, no_docs):
    kinds = {"aa": ["bala", "kola", "mala", "the"], "bb": ["zuxi", "wexu", "quzy", "the"], "cc": ["ñandú", "señal", "the"]}
    rng = random.Random(11)
    rows = [
        (i, " ".join(rng.choice(kinds[lang]) + rng.choice(["", "la", "xy"]) for _ in range(20)), lang, "s", 0)
        for i in range(300) for lang in (list(kinds)[i % 3],)
    ]
    rows += [(1000, None, "aa", "s", 0), (1001, "123 ²½ --", "bb", "s", 0), (1002, "Bala KOLA", None, "s", 0), (1003, "balakola", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:300])
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "aa", "aa"]
    assert got[1000].score == got[1001].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert len(language.identify(odd_docs).collect()) == 12 and language.identify(no_docs).count() == 0


def brute_language(rows):
    """Word-first back-off in plain Python: (lang, score) of every text."""
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    words_of = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = {0: {}, 1: {}, 2: {}, 3: {}, 4: {}}
    for i, text, lang, *_ in rows:
        if lang is None or text is None or crc(i) == 0:
            continue
        for w in words_of(text):
            counts[0].setdefault(lang, Counter())[w] += 1
            for k in (1, 2, 3, 4):
                m = f"^{w}$"
                counts[k].setdefault(lang, Counter()).update(m[a : a + k] for a in range(len(m) - k + 1))
    languages = sorted(counts[0])
    kinds = {k: set().union(*counts[k].values()) for k in counts}

    def log(k, item):
        return np.array([np.log((counts[k][x][item] + 0.5) / (counts[k][x].total() + 0.5 * len(kinds[k]))) for x in languages])

    def score(w):
        if w in kinds[0]:
            return log(0, w)
        for k in (4, 3, 2, 1):
            own = [f"^{w}$"[a : a + k] for a in range(len(w) + 3 - k)]
            if known := [log(k, g) for g in own if g in kinds[k]]:
                return np.mean(known, 0)
        return np.zeros(len(languages))

    for _, text, *_ in rows:
        found = words_of(text or "")
        if not found:
            yield "und", 0.0
            continue
        total = np.mean([score(w) for w in found], 0) * min(len(found), 12)
        share = np.exp(total - total.max())
        yield languages[int(share.argmax())], share.max() / share.sum()


def test_language_against_brute_force(spark):
    rng = random.Random(24)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "ñòéabxy"}
    make = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 7)))
    rows = [(i, " ".join(make(x) for _ in range(rng.randrange(1, 15))), x if i % 11 else None, "s", 0) for i in range(240) for x in (list(letters)[i % 3],)]
    rows += [(900, "abc efgh ñoa qqq", None, "s", 0), (901, "qqq ωω", None, "s", 0), (902, None, "aa", "s", 0)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    for (i, *_), (lang, score) in zip(rows, brute_language(rows), strict=True):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, rel=1e-4), i


def test_sample_has_one_row_per_identifier(spark):
    rows = [(7, f"bala{i} bala kola", "aa", "s", 0) for i in range(500)] + [(i, "zuxi wexu", "bb", "s", 0) for i in range(20, 60)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    assert sum(w.startswith("bala") for w in model.words) <= 2 and "zuxi" in model.words


def test_long_texts_are_scored_in_slices(monkeypatch):
    rows = pa.table({"lang": ["a", "b", "a", "b"], "length": [0] * 4, "item": ["ja", "no", None, None], "n": [5, 5, 5, 5]})
    scorer = language.Scorer(language.build(rows))
    text = "ja no ja ja " * 50
    whole = scorer.predict(text)
    monkeypatch.setattr(language, "_SLICE", 16)
    assert scorer.predict(text) == pytest.approx(whole) and whole[0] == "a"

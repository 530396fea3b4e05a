"""Operators over whole tables: mixing, packing, surrogates, similarity join, licences, archives."""

import gzip
import hashlib
import io
import ipaddress
import itertools
import random
import string
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwork.llm import components, jaccard, keyfilter, licences, mixing, order, packing, pii, vocab, warc
from siftwork.llm.common import Workspace

from .conftest import DOCS, words

# ------------------------------------------------------------------------------------ order


def test_running_sums_cut_a_group_anywhere(spark):
    rows = [(("hot", "b", None)[0 if i % 3 else i % 7 % 3], i * 37 % 101, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = order.running_sums(df, Workspace(spark), ["g"], ["o"], {"upto": F.col("v")}).collect()
    totals = Counter()
    for r in sorted(got, key=lambda r: (str(r.g), r.o, r.upto)):
        totals[r.g] += r.v
        assert r.upto == totals[r.g]
    assert len(got) == 400


# ----------------------------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = budget * sum(sizes.values()), {}, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= full


def test_mix_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "é", "Z", "zz", None, "a", "a"]), 0) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and r.size == len(rows[r.doc_id][1].split())
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    mixed = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(mixed[r.doc_id] == r.copies for r in got)


def test_heavier_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * 10 + ("#### " * 20 if i % 2 else ""), "en", f"s{i % 3}", 0) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), budget=0.3).collect()
    counts = Counter(r.doc_id % 2 for r in got if r.copies)
    assert counts[0] > 2 * counts[1]


def test_mix_of_odd_rows(odd_docs, no_docs, clashing):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 12 and sum(r.size == 0 for r in rows) == 3
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    assert mixing.mixed(clashing).columns == clashing.columns and mixing.mixed(clashing).count() > 0


# ---------------------------------------------------------------------------------- packing


def test_tokens_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoding = vocab.byte_level(vocab.byte_file())
    rng = random.Random(2)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext| >", " <|endoftext|>\n"]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "a", "\n", "é", "1", "'s", "<|"]) for _ in range(30)) for _ in range(100)]
    assert whole.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts += ["", "Hello  world\n\n x", "<|endoftext|> é😀 ñ", "a\tb  \n c'll it's 123abc", "\x1c\x85\xa0 x", "日本語 テスト", words(rng, 300)]
    for t in texts:
        assert packing.token_ids(encoding, t).tolist() == whole.encode(t, add_special_tokens=False).ids + [0]
    assert packing.token_ids(encoding, None).tolist() == [0]


def test_long_texts_are_encoded_in_slices(monkeypatch):
    encoding = vocab.byte_level(vocab.byte_file())
    text = ("word  two\n\n three, 45 <|endoftext|> 'll é " * 40) + "x" * 500
    whole = packing.token_ids(encoding, text).tolist()
    monkeypatch.setattr(vocab, "_SLICE", 7)
    assert packing.token_ids(encoding, text).tolist() == whole


def test_cuts():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(20, 10) == [(0, 10), (10, 10)] and packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_capacity_holds(by):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 500)
    sequence, offset = packing.best_fit(lengths, 100, documents=4, attention=6000 + 4000, by=by)
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == np.concatenate([[0], np.cumsum(lengths[own])[:-1]]).tolist()
        assert lengths[own].sum() <= 100 and len(own) <= 4 and (lengths[own] ** 2).sum() <= 10000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100)
    assert len(packing.best_fit(np.array([], int), 100)[0]) == 0


def test_capacities_bind(spark):
    rng = random.Random(34)
    texts = [words(rng, rng.choice([2, 5, 60, 300, 500])) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    attention = packing.LENGTH**2 // 2
    found = {}
    for r in packing.pack_documents(docs, keep_ids=False, documents=8, attention=attention).collect():
        found.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(own) <= packing.LENGTH and len(own) <= 8 for own in found.values())
    assert all(sum(n * n for n in own) <= attention for own in found.values() if len(own) > 1)
    # Both bind: with each of them alone there would be fewer sequences.
    alone = [packing.pack_documents(docs, keep_ids=False, **c).select("sequence_id").distinct().count() for c in ({"documents": 8}, {"attention": attention})]
    assert len(found) > max(alone) and any(len(own) == 8 for own in found.values())


def test_packing_round_trip(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, block=5).collect()
    encoding = vocab.byte_level(vocab.byte_file())
    want = Counter(tuple(packing.token_ids(encoding, r.text).tolist()) for r in odd_docs.collect())
    assert sum(r.length for r in rows) == sum(len(k) * n for k, n in want.items())
    sequences = defaultdict(list)
    for r in rows:
        assert r.length == len(r.token_ids) and r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    text = next(r.text for r in odd_docs.collect() if r.doc_id == 5)
    assert [i for r in long for i in r.token_ids] == packing.token_ids(encoding, text).tolist()
    assert [r.start for r in long] == [0, *np.cumsum([r.length for r in long])[:-1]]
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_is_tight(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(1, 300))) for i in range(1500)], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, keep_ids=False).collect()
    assert len({r.sequence_id for r in rows}) <= sum(r.length for r in rows) / packing.LENGTH * 1.01 + 1


# ------------------------------------------------------------------------------- surrogates


def kinds(text):
    return [(s[2].partition(":")[0], text[s[0] : s[1]]) for s in pii.find(text)]


def test_detection():
    assert kinds("mail A.b+c@Mail.example.com, x@y and @z") == [("email", "A.b+c@Mail.example.com")]
    assert kinds("card 4111 1111 1111 1111 not 4111111111111112 nor 9111111111111111") == [("card", "4111 1111 1111 1111")]
    assert kinds("ip 10.1.2.3, 300.1.2.3 1.2.3.4.5 8.8.8.8!!") == [("ip", "10.1.2.3"), ("ip", "8.8.8.8")]
    assert kinds("call +1 (826) 555-4081 190.137.2.1") == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.2.1")]
    assert kinds("+49 30 1234567 4.0 2024-01-02") == [("phone", "+49 30 1234")] or kinds("+49 30 1234 567")[0][0] == "phone"
    assert kinds('token = "9a8b7c6d5e4f30211203f4e5d6c7b8a9"') == [("secret", "9a8b7c6d5e4f30211203f4e5d6c7b8a9")]
    assert kinds("Frau Anna Müller and Dr. Müller met Mr lower") == [("given", "Anna"), ("family", "Müller"), ("family", "Müller")]
    assert kinds("SSN 123-45-6789") == [("ssn", "123-45-6789")]
    assert pii.find(None) == pii.find("") == pii.find("Version 2.0, 1234567890123456 and more words") == []


@pytest.mark.parametrize("number", [
    "+4915112345678", "+442071838750", "+12025550143", "+1 2025550143", "+49 30 1234567", "+49 (30) 1234567", "+49 (0)30 1234567",
    "+33 1 23 45 67 89", "+33.1.23.45.67.89", "+1 (202) 555-0143", "+1(202)555-0143", "+49 30 1234567-12", "+7 495 123-45-67", "+353 1 234 5678",
    "+49 30 1234 567", "+5 (243) 555-5526", "(202) 555 0143", "202 555 0143", "202-555-0143", "030 1234567", "020 7183 8750", "0151 12345678",
])
def test_formats_of_telephone_numbers(number):
    for text in (f"call {number}", f"tel:{number}, or so", f"{number} 4.0 2024-01-02", f"({number})", f"{number}\n10:30"):
        assert kinds(text) == [("phone", number)], text
    new = pii.replace(number, "k")
    assert new != number and len(new) == len(number) and kinds(new) == [("phone", new)]
    country = pii._COUNTRY.match(number)
    assert new.startswith(country[0] if country else "")


def test_numbers_that_are_not_for_telephones():
    assert kinds("1+2 345 6789, +12345, a+12345678b, +1234567890123456, v2 +3.14159, 2024-01-02 10:30 100 200 300") == []
    assert len({s[3] for t in ("+4915112345678", "+49 151 12345678", "+49 (0)151-12345678") for s in pii.find(t)}) == 1
    assert len({s[3] for t in ("+12025550143", "+1 202 555 0143", "(202) 555-0143") for s in pii.find(t)}) == 1


def test_names_of_any_number_of_words():
    assert kinds("Mr Juan Carlos García López came") == [("given", "Juan"), ("given", "Carlos"), ("given", "García"), ("family", "López")]
    assert kinds("Doña Ana María Del Carmen Ruiz Soto")[-1] == ("family", "Soto")


CASES = [
    ("Mr Ludwig van Beethoven played", [("given", "Ludwig"), ("family", "Beethoven")]),
    ("Mrs Maria da Silva", [("given", "Maria"), ("family", "Silva")]),
    ("Mr. J. García wrote", [("initial", "J"), ("family", "García")]),
    ("M. Dupont arrive", [("family", "Dupont")]),
    ("DR. ANA SILVA", [("given", "ANA"), ("family", "SILVA")]),
    ("Mr. Juan\u00a0García came", [("given", "Juan"), ("family", "García")]),
    ("Dr. Ana Silva said yes. Silva replied to ANA.", [("given", "Ana"), ("family", "Silva"), ("family", "Silva"), ("given", "ANA")]),
    ("Mr. Smith's car, Smith’s dog", [("family", "Smith"), ("family", "Smith")]),
    ("Mr Sean O'Brien-Smith Jr. left", [("given", "Sean"), ("family", "O'Brien-Smith")]),
    ("IBAN DE89 3704 0044 0532 0130 00 OK", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("to GB82WEST12345698765432.", [("iban", "GB82WEST12345698765432")]),
    ("SSN 123 45 6789", [("ssn", "123 45 6789")]),
    ("at 2001:db8::8a2e:370:7334, 10:30:45", [("ip6", "2001:db8::8a2e:370:7334")]),
    ("from AKIA" + "QZ7X" * 4 + " on", [("secret", "AKIA" + "QZ7X" * 4)]),
    ("from ghp_" + "a1B" * 12 + " on", [("secret", "ghp_" + "a1B" * 12)]),
    ("password: hunter2hunter2", [("secret", "hunter2hunter2")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_entities_of_a_text(text, want):
    assert kinds(text) == want
    new = pii.replace(text, "k")
    assert len(kinds(new)) == len(want) and not {v for _, v in kinds(new)} & {v for _, v in want}
    # All else stays: without its entities the text is the same.
    strip = lambda t: [t[a:b] for a, b in zip([0, *(s[1] for s in pii.find(t))], [*(s[0] for s in pii.find(t)), len(t)], strict=True)]
    assert strip(new) == strip(text)


def test_texts_without_entities():
    for text in ("Password: required", "std::vector a::b 10:30:45 1:2:3:4", "DE12 3456 WORDS HERE", "Mr and Mrs", "the SSN of a ship", "Dr. van"):
        assert kinds(text) == [], text


def test_mentions_of_one_name_agree():
    new = pii.replace("Dr. Ana Silva came. Mrs. Ana Silva left with ANA SILVA's bag. silva", "k")
    given, family = pii._like_mention("given", "Ana", pii.surrogate("given:f", "ana", 0, "k")), pii._like_mention("family", "Silva", pii.surrogate("family", "silva", 0, "k"))
    assert new == f"Dr. {given} {family} came. Mrs. {given} {family} left with {given.upper()} {family.upper()}'s bag. silva"


def test_addresses_stay_addresses():
    for n in range(60):
        for entity in ("192.168.1.1", "8.8.8.8"):
            assert str(ipaddress.ip_address(pii.surrogate("ip", entity, n, "k"))).count(".") == 3
        assert ipaddress.ip_address(pii.surrogate("ip6", "fe80::1", n, "k")).is_link_local
        assert pii._mod97(pii.surrogate("iban", "DE89370400440532013000", n, "k")) == 1


def test_one_name_under_two_kinds_collides_with_nothing(spark):
    """Four-letter names of both genders: many meet on their first draw, none in the end."""
    names = ["".join(x) for x in itertools.product("abel", repeat=4)]
    entities = [("given", f"given:{g}", n) for n in names for g in "mf"]
    df = spark.createDataFrame(entities, "class string, kind string, entity string")
    again = {(r.kind, r.entity): r.attempt for r in pii.resolve(df, Workspace(spark), "k").collect()}
    final = [pii.surrogate(k, e, again.get((k, e), 0), "k") for _, k, e in entities]
    assert len(set(final)) == len(entities) and not set(final) & set(names)


def test_surrogates_keep_type_format_gender_and_script():
    text = "Mr. Ivan Petrov, Госпожа Анна Иванова, A@Bc.org a@bc.org +1 (243) 555-5526 (243) 555-5526 4111-1111-1111-1111 10.1.2.3 8.8.8.8"
    new = pii.replace(text, "k")
    assert [k for k, _ in kinds(new)] == [k for k, _ in kinds(text)] and new == pii.replace(text, "k") != pii.replace(text, "other")
    found = [v for _, v in kinds(new)]
    assert not set(found) & {v for _, v in kinds(text)}
    by = dict(kinds(new))
    emails, phones = ([v for k, v in kinds(new) if k == kind] for kind in ("email", "phone"))
    assert emails[0].lower() == emails[1] and phones[0].endswith(phones[1])
    assert pii._luhn(pii._digits(by["card"])) == 0 and by["card"].count("-") == 3 and by["card"][0] == "4"
    assert [v for k, v in kinds(new) if k == "ip"][0].startswith("10.")
    assert all("а" <= c <= "я" for c in found[2].lower())
    given = lambda g, n: pii.surrogate(f"given:{g}", n, 0, "k")
    assert all(given("f", n).endswith(("a", "ia", "ine", "elle")) and given("m", n).endswith(("o", "an", "us", "ert")) for n in ("ann", "bob", "cleo"))
    for script in ("иван", "γιώργος", "דוד", "李小龙"):
        assert pii._script(pii.surrogate("family", script, 0, "k")[0]) == pii._script(script[0])


def test_collisions_are_drawn_again(spark, monkeypatch):
    """With surrogates from a tiny range every entity still has one of its own, and none is an entity."""
    monkeypatch.setattr(pii, "surrogate", lambda kind, entity, attempt, key: f"s{(len(entity) * 7 + sum(map(ord, entity)) + attempt * 13) % 41}")
    entities = [("x", "x", f"e{i}") for i in range(15)] + [("x", "x", f"s{i}") for i in range(5)]
    df = spark.createDataFrame(entities, "class string, kind string, entity string")
    again = {r.entity: r.attempt for r in pii.resolve(df, Workspace(spark), "k").collect()}
    final = [pii.surrogate("x", e, again.get(e, 0), "k") for _, _, e in entities]
    assert len(set(final)) == 20 and not set(final) & {e for _, _, e in entities}
    monkeypatch.setattr(pii, "surrogate", lambda kind, entity, attempt, key: entity + "'")
    assert pii.resolve(df, Workspace(spark), "k") is None


def test_blanks_are_no_secrets():
    assert kinds("Password: ______________________") == kinds("Token:\n--------------------") == kinds("secret = ====+/====+/====") == []
    assert kinds("Password: ______________________x1") == [("secret", "______________________x1")]


def test_every_entity_changes_in_some_attempt():
    entities = [("family", "պետրոսյան"), ("given:f", "สมหญิง"), ("email", "สมชาย@ไทย.ไทย"), ("family", "김"), ("family", "ế"), ("secret", "_" * 20 + "é")]
    for kind, entity in entities:
        assert any(pii.surrogate(kind, entity, n, "k") != entity for n in range(3)), entity
    assert unicodedata.name(pii.surrogate("family", "պետրոսյան", 0, "k")[0]).startswith("ARMENIAN SMALL")


def test_space_of_surrogates_grows(spark):
    """More entities than surrogates of their format, all of which are entities: each still gets its own."""
    letters = string.ascii_lowercase
    short = [("email", "email", f"{a}@{b}.co") for a in letters for b in letters]
    private = [f"192.168.{a}.{b}" for a in range(1, 255) for b in range(1, 255)]
    taken = {e for _, _, e in short} | set(private)
    for kind, entity in (("email", "a@b.co"), ("ip", "192.168.1.1")):
        assert any(pii.surrogate(kind, entity, n, "k") not in taken for n in range(40))
    for kind, entity in (("given:m", "ann"), ("family", "李"), ("secret", "_" * 20 + "x"), ("phone", "3012"), ("ssn", "123456789"), ("card", "4" * 16)):
        assert len(pii.surrogate(kind, entity, 40, "k")) > len(entity)
    given = [("given", "given:m", f"n{i}") for i in range(300)]
    names = [("given", "given:m", pii.surrogate("given:m", f"n{i}", n, "k")) for i in range(300) for n in range(2)]
    entities = sorted(set(short + given + names))
    df = spark.createDataFrame(entities, "class string, kind string, entity string")
    again = {(r["class"], r.entity): r.attempt for r in pii.resolve(df, Workspace(spark), "k").collect()}
    final = [(c, pii.surrogate(k, e, again.get((c, e), 0), "k")) for c, k, e in entities]
    assert len(set(final)) == len(entities) and not set(final) & {(c, e) for c, _, e in entities}
    assert pii._like_mention("phone", "+49 30 12", "301299") == "+49 30 1299"


def test_redrawn_entities_reach_their_documents(spark, monkeypatch):
    redrawn = spark.createDataFrame([("email", "a@b.org", 3)], "class string, entity string, attempt int")
    monkeypatch.setattr(pii, "resolve", lambda *a: redrawn)
    docs = spark.createDataFrame([(1, "a@b.org c@d.org"), (2, "c@d.org"), (None, "A@B.org"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.with_surrogates(docs).collect()}
    draw = lambda e, n: pii.surrogate("email", e, n, pii.DEFAULT_KEY)
    assert got[1] == f"{draw('a@b.org', 3)} {draw('c@d.org', 0)}" and got[2] == draw("c@d.org", 0)
    assert got[None].lower() == draw("a@b.org", 3) and got[3] is None


def test_surrogates_of_odd_rows(odd_docs, no_docs, clashing):
    for docs in (odd_docs, clashing):
        got = pii.with_surrogates(docs)
        assert got.columns == docs.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert pii.with_surrogates(no_docs).count() == 0


# --------------------------------------------------------------------------- similarity join


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), Workspace(spark)).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), Workspace(spark)).count() == 0


def brute_components(rows, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(low).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    names = [i for i, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, name in enumerate(names):
        least[find(i)] = min(least.get(find(i), name), name)
    return {n: (len(s), least[find(i)]) for i, (n, s) in enumerate(zip(names, sets, strict=True))}


def near_copies(seed, groups, copies, common=""):
    """Groups of texts with a few words changed, around the threshold, and a passage many share."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = words(rng, rng.randrange(4, 60)).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own) + common * (rng.random() < 0.5))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size, percent, block", [(3, 90, 2048), (5, 80, 2048), (3, 70, 8), (1, 100, 2048)])
def test_join_against_brute_force(spark, size, percent, block):
    texts = near_copies(size, 40, 9, " the passage that many documents of this table share with each other")
    texts += ["", None, " ", "One", "one", "one two", "ONE two", "É x", "é x"]
    rows = list(enumerate(texts, 1000))
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), size, percent, block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, size, percent)


def test_bounds_discard_no_pair_that_links():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.choice([3, 50, 200, 900, 3000])).astype(np.uint64) * 2)
        keep = rng.random(len(a)) < rng.choice([1, 0.97, 0.9, 0.8])
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        fold = lambda x: jaccard.Folds([jaccard.folded(x)])
        one = np.array([0])
        bound = fold(a).bounds(np.array([len(a)]), fold(b), np.array([len(b)]), one, one, 90)[0]
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert bound >= both
    assert jaccard.folded(np.arange(30, dtype=np.uint64)) == b""
    assert jaccard.Folds([b""]).bounds(np.array([300]), fold(a), np.array([300]), one, one, 90)[0] == 300


def test_one_document_of_each_group_stays(spark, odd_docs, no_docs, clashing):
    texts = near_copies(9, 12, 6)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, other string")
    want = brute_components(list(enumerate(texts)), 5, 80)
    kept = sorted(r.doc_id for r in jaccard.one_per_component(docs, 5, 80).collect())
    assert kept == sorted({c for _, c in want.values()})
    for docs in (odd_docs, clashing):
        left = jaccard.one_per_component(docs, 5, 80)
        rows = left.collect()
        # Repeated rows and the near copy of the long text go; texts without words stay.
        assert left.columns == docs.columns and len(rows) == 9 and Counter(r.doc_id for r in rows)[1] == 1
    assert jaccard.one_per_component(no_docs, 5, 80).count() == 0 and jaccard.link_components(no_docs, 3, 90).count() == 0
    assert jaccard.link_components(odd_docs, 3, 90).count() == 12


def unlinked_copies(seed, n, changed):
    """Copies of one text, each with other words changed: most pairs are just below the threshold."""
    rng = random.Random(seed)
    base = words(rng, 240).split()
    texts = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(len(base)), changed + k % 3):
            own[at] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [2048, 12])
def test_group_of_unlinked_copies(spark, block, monkeypatch):
    texts = unlinked_copies(31, 150, 4) + near_copies(32, 6, 8)
    rows = list(enumerate(texts))
    seen = []
    settle = jaccard.Join.settle

    def spy(join, forest):
        seen.append((forest.count(), join.distinct.count()))
        settle(join, forest)

    monkeypatch.setattr(jaccard.Join, "settle", spy)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = jaccard.link_components(docs, 5, 80, block)
    want = brute_components(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) > 60
    # Each of the tasks' forests has fewer rows than the task has documents.
    assert seen and all(n < 4 * rows for n, rows in seen)


def test_overlaps_are_those_of_sets():
    rng = random.Random(33)
    sets = [sorted(rng.sample(range(400), rng.randrange(1, 200))) for _ in range(150)] + [list(range(300)), [7]]
    got = jaccard.overlaps(pa.array(sets, pa.list_(pa.int64())))
    want = [[len(set(a) & set(b)) if i < j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert got.tolist() == want


def test_key_filter(spark):
    keys = spark.createDataFrame([(k,) for k in (-5, 0, 7, 2**62, None)], "k bigint")
    table = keyfilter.build(keys, "k")
    rows = keys.unionByName(spark.range(50, 90).toDF("k"))
    held = {r.k: r.h for r in rows.select("k", keyfilter.may_hold(table, F.col("k")).alias("h")).collect()}
    assert all(held[k] for k in (-5, 0, 7, 2**62)) and held[None] is False and not any(held[k] for k in range(50, 90))


# --------------------------------------------------------------------------------- licences


def test_licences(spark):
    files = [
        (1, "p/LICENSE", "Released under the MIT License."),
        (2, "p/a.txt", "some text\nLicensed under the Apache License, Version 2.0.\nmore"),
        (3, "p/q/r/b.txt", "no statement"),
        (4, "p/q/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "p/q/c.txt", None),
        (6, "o/d.txt", ""),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, "top.txt", "the licence of this is a secret of its own kind, unlike any other"),
        (9, "p/q/c.txt", None),
        (10, "LICENSEE/x.txt", "plain"),
    ]
    got = {r.file: (r.licence, r.origin, r.inherited_from) for r in licences.scan(spark.createDataFrame(files, "file bigint, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("Apache-2.0", "own", None), 3: ("GPL-3.0", "inherited", "p/q"), 4: ("GPL-3.0", "own", None),
        5: ("GPL-3.0", "inherited", "p/q"), 6: (None, "none", None), 7: ("CC-BY-NC-4.0", "own", None), 8: (None, "none", None),
        9: ("GPL-3.0", "inherited", "p/q"), 10: (None, "none", None),
    }


def test_licence_cosine_against_brute_force(spark):
    import math
    import re

    files = [(i, f"d/{i}.txt", f"{t} {'extra words here' * (i % 3)}") for i, (_, t) in enumerate(licences.TEMPLATES)]
    df = spark.createDataFrame(files, "file bigint, path string, text string")
    found = licences.detect(df, Workspace(spark), 0.1).join(df.withColumn("key", licences._key()), "key")
    got = {r.file: (r.licence, r.score) for r in found.collect()}
    plain = lambda t: re.sub(r"\b(?:version|v)[\W_]{0,12}(\d+)((?:\.\d+)*)(?!\w)", lambda m: f"v{m[1]}" + m[2].replace(".0", "").replace(".", "_"), t.lower())
    count = lambda t: Counter(re.findall(r"v\d+_\d+|[^\W_]+", plain(t)))
    versions = lambda c: {w for w in c if re.match(r"v\d", w)}
    cued = {i: count(t) for i, _, t in files if re.search(licences._CUE, t)}
    n, df = len(cued), Counter(w for c in cued.values() for w in c)
    vector = lambda c: {w: (1 + math.log(k)) * (1 + math.log((n + 1) / (df[w] + 1))) for w, k in c.items()}
    for i, c in cued.items():
        a = vector(c)
        best = []
        for licence, text in licences.TEMPLATES:
            b = vector(count(text))
            if versions(a) and versions(b) and not versions(a) & versions(b):
                continue
            cos = sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            best.append((-round(cos, 9), licence))
        want = min(best)[1]
        if want.startswith("BSD-"):  # told by the clauses of the file
            text = files[i][2].lower()
            third, second = "neither the name" in text or "3-clause" in text, "redistributions in binary form must" in text or "2-clause" in text
            want = "BSD-3-Clause" if third else "BSD-2-Clause" if second else want
        assert got[i][0] == want and got[i][1] == pytest.approx(-min(best)[0], abs=1e-8)


def test_wrapped_statements_and_those_without_a_cue_word(spark):
    texts = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\nimport os\nimport sys",
        "/*\n * This work is licensed under the GNU General\n * Public License,\n * version 3.\n */\nint main(void) { return 0; }\nint other;",
        "// Copyright 2020 Some Body of Elsewhere.\r\n// Licensed under the\r\n// Apache License, Version\r\n// 2.0.\r\n\r\nvar x;",
        "This work is licensed under\nthe GNU General Public License,\nversion 2.\n\nAnother paragraph about nothing at all.",
        "plain words\nof a text without any statement\n\nand another paragraph",
    ]
    files = spark.createDataFrame([(i, f"d/{i}.txt", t) for i, t in enumerate(texts)], "file bigint, path string, text string")
    got = {r.file: r.licence for r in licences.scan(files).collect() if r.licence}
    assert got == {0: "BSD-3-Clause", 1: "BSD-3-Clause", 2: "GPL-3.0", 3: "Apache-2.0", 4: "GPL-2.0"}


_GNU_HEADER = """{mark} This {thing} is free software; you can redistribute it and/or
{mark} modify it under the terms of the {name}
{mark} as published by the Free Software Foundation; either version {version}
{mark} of the License, or (at your option) any later version.
{mark}
{mark} This {thing} is distributed in the hope that it will be useful,
{mark} but WITHOUT ANY WARRANTY; without even the implied warranty of
{mark} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

code = 1
"""
_BSD_FILE = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
LICENCES = [
    ("a.py", _GNU_HEADER.format(mark="#", thing="program", name="GNU General Public License", version="2"), "GPL-2.0"),
    ("b.c", _GNU_HEADER.format(mark=" *", thing="program", name="GNU General Public License", version="3"), "GPL-3.0"),
    ("c.c", _GNU_HEADER.format(mark="//", thing="library", name="GNU Lesser General Public License", version="2.1"), "LGPL-2.1"),
    ("d.c", _GNU_HEADER.format(mark="//", thing="library", name="GNU Lesser General Public License", version="3"), "LGPL-3.0"),
    ("e.py", _GNU_HEADER.format(mark="#", thing="program", name="GNU Affero General Public License", version="3"), "AGPL-3.0"),
    ("f/LICENSE", _BSD_FILE.format(third=""), "BSD-2-Clause"),
    ("g/LICENSE", _BSD_FILE.format(third=_THIRD), "BSD-3-Clause"),
    ("h/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n", "Apache-2.0"),
    ("i/LICENSE", "Copyright 2020 Some Body\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", "ISC"),
    ("j.c", "// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"),
    ("k.c", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "GPL-2.0"),
    ("l.c", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */\nint x;", "MIT"),
    ("m.java", "/*\n * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.\n */\nclass X {}", "MPL-2.0"),
    ("n.java", "// This program and the accompanying materials are made available under\n// the terms of the Eclipse Public License 2.0\nclass X {}", "EPL-2.0"),
    ("o.c", "// licensed under version 9 of nothing at all\nint x;", None),
]


def test_licences_of_common_notices(spark):
    files = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(LICENCES)], "file bigint, path string, text string")
    got = {r.file: (r.licence, r.origin) for r in licences.scan(files).collect()}
    assert {LICENCES[i][0]: v[0] for i, v in got.items()} == {p: licence for p, _, licence in LICENCES}
    assert all(origin == ("own" if LICENCES[i][2] else "none") for i, (_, origin) in got.items())


def test_files_with_null_or_repeated_identifiers(spark):
    rows = [(None, "a/x", "Released under the MIT License."), (None, "b/x", "Licensed under CC BY 4.0."), (1, "c/x", "Released under the MIT License."),
            (1, "c/x", "plain"), (1, "c/x", "Released under the MIT License."), (1, None, None), (None, None, "Licensed under CC BY 4.0.")]
    files = spark.createDataFrame(rows, "file bigint, path string, text string").repartition(3)
    got = Counter((r.file, r.path, r.licence) for r in licences.scan(files).collect())
    assert got == Counter({
        (None, "a/x", "MIT"): 1, (None, "b/x", "CC-BY-4.0"): 1, (1, "c/x", "MIT"): 2, (1, "c/x", None): 1, (1, None, None): 1, (None, None, "CC-BY-4.0"): 1,
    })


def test_licences_of_an_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], "file bigint, path string, text string")).count() == 0


# --------------------------------------------------------------------------------- archives


def test_archives(spark, monkeypatch):
    big = "é" * 700_000
    pages = [(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", "own\r\n\r\nWARC/1.1\r\n"),
             (None, "u", "same"), (None, "u", "only without id"), (7, "u", "twice"), (7, "u", "twice")]
    monkeypatch.setattr(warc, "CHUNK", 1 << 18)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    chunks = warc.archive_round_trip(df).collect()
    records = defaultdict(list)
    for c in chunks:
        records[c.page_id, c.payload_digest if c.last else None].append(c)
    last = [c for c in chunks if c.last]
    assert len(last) == 10 and all(c.intact for c in last)
    digest = lambda t: warc.base32_sha1(hashlib.sha1((t or "").encode()).digest())
    assert sorted((str(c.page_id), c.payload_digest, c.payload_bytes) for c in last) == sorted((str(i), digest(t), len((t or "").encode())) for i, _, t in pages)
    kinds_ = {(c.page_id, c.payload_digest): (c.record_type, c.refers_to) for c in last}
    assert kinds_[1, digest("same")] == ("revisit", 2) and kinds_[2, digest("same")] == ("response", None)
    assert kinds_[None, digest("same")] == ("revisit", 2) and kinds_[None, digest("only without id")] == ("response", None)
    assert kinds_[3, digest("")] == ("revisit", 4) and kinds_[7, digest("twice")] == ("response", None)
    own = sorted((c for c in chunks if c.page_id == 5), key=lambda c: c.chunk)
    assert b"".join(c.data for c in own).decode() == big and len(own) > 1 and max(len(c.data) for c in own) <= 1 << 20
    running = hashlib.sha1()
    for c in own:
        running.update(c.data)
        assert c.payload_digest == warc.base32_sha1(running.digest())


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    got = {c.page_id: c.refers_to for c in warc.archive_round_trip(pages, least=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_a_full_segment_starts_a_new_file_and_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 100) for i in range(9)], "page_id bigint, url string, html string").coalesce(1)
    marked = pages.withColumn("refers_to", F.lit(None).cast("bigint"))
    manifest = Workspace(spark).keep(warc.write_archives(marked, str(tmp_path / "w"), segment=300))
    assert [r.records for r in manifest.collect()] == [3, 3, 3]
    assert warc.read_archives(spark, manifest).count() == 9
    raw = gzip.open(manifest.first().path).read()
    changed = raw.replace(b"x" * 100, b"x" * 99 + b"y", 1)
    rows = list(warc.read_records(io.BufferedReader(io.BytesIO(changed))))
    assert [r[9] for r in rows].count(False) == 1
    with pytest.raises(EOFError):
        list(warc.read_records(io.BufferedReader(io.BytesIO(raw[:-60]))))


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0

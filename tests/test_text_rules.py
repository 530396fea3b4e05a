"""Text rules: what they find in the literal texts of :mod:`tests.texts`, stated text by text."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwork import catalogues as cat
from siftwork.functions import classify, embedding, extract, pyrules, regex, secrets, text
from siftwork.operators import enrich

from .texts import TEXTS


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"https://example.com/{i}/doc.md", t, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "seq bigint, url string, raw_content string, error string").repartition(4).cache()


def values(df, column, key="seq"):
    return {r[key]: r[column] for r in df.collect()}


def everywhere(docs, column):
    got = values(docs.withColumn("_hay", regex.needle_text("raw_content")).select("seq", column.alias("v")), "v")
    return [got[i] for i in range(len(TEXTS))]


def by_text(found, default):
    return [found.get(i, default) for i in range(len(TEXTS))]


ASSIGNED = {
    5: ['system prompt: "be brief"\n', "system_prompt='x'\n", "SYSTEM\xa0PROMPT = unicode space"],
    6: ["system prompt:\n\nvalue after blank lines\n"],
}
SECTIONS = {
    7: ["# Rules\n\nfirst\nsecond", "## Instructions\nbody", "# Prompt\nlast one"],
    8: ["## System Prompt   \nbody to the end"],
    9: ["#Rule\nno"],
}
TAGGED = {10: ["<system>one</system>", "<SYSTEM>two\nlines</SYSTEM>"]}
PERSONA_SPANS = {
    2: ["You are a helpful bot.\nDo not lie. Never give up\nmust  not  do that. REFUSE it, prohibited"],
    3: ["YOU ARE the one   \nYou are second"],
    4: ["You are not at a line start"],
    11: ["Act as an expert " + "y" * 390, "Assistant is good"],
    12: [TEXTS[12]],
}


@pytest.mark.parametrize(
    "fn, found",
    [
        (extract.prompt_assign, ASSIGNED),
        (extract.prompt_section, SECTIONS),
        (extract.prompt_system_tag, TAGGED),
        (extract.prompt_persona_span, PERSONA_SPANS),
    ],
)
def test_prompt_patterns(docs, fn, found):
    assert everywhere(docs, fn("raw_content", "_hay")) == by_text(found, [])


def test_prompt_blocks(docs):
    blocks = by_text(PERSONA_SPANS, [])
    for i, found in (ASSIGNED | SECTIONS).items():
        blocks[i] = [b.strip() for b in found]
    blocks[10] = [*TAGGED[10], "one", "two\nlines"]
    assert everywhere(docs, extract.prompt_blocks("raw_content", "_hay")) == blocks


def test_persona_constraints_tech(docs):
    personas = {2: "You are a helpful bot.", 3: "YOU ARE the one"}
    assert everywhere(docs, extract.persona("raw_content", "_hay")) == by_text(personas, None)
    constraints = {2: ["Do not lie", "Never give up", "must  not  do that", "REFUSE it, prohibited"]}
    assert everywhere(docs, extract.constraints("raw_content", "_hay")) == by_text(constraints, [])
    tech = {11: ["go"], 21: ["aws"], 22: ["aws"], 34: ["javascript", "rust", "go", "java"], 35: ["langchain", "crewai"]}
    assert everywhere(docs, extract.tech_stack("lower(raw_content)")) == by_text(tech, [])


def test_lines_strip_hash_length(docs):
    assert everywhere(docs, text.lines("raw_content")) == [t.splitlines() for t in TEXTS]
    assert everywhere(docs, regex.strip("raw_content")) == [t.strip() for t in TEXTS]
    assert everywhere(docs, text.content_hash("raw_content")) == [hashlib.sha256(t.encode()).hexdigest() for t in TEXTS]
    assert everywhere(docs, text.content_length("raw_content")) == [len(t) for t in TEXTS]


def test_entropy_and_redaction(spark, docs):
    known = {"": 0.0, "aaaa": 0.0, "ab": 1.0, "aabb": 1.0, "abcd": 2.0, "aaab": 0.811278, "0123456789abcdef": 4.0, "éèé": 0.918296}
    df = spark.createDataFrame([(t,) for t in known], "raw_content string")
    got = {r.raw_content: r.e for r in df.select("raw_content", text.shannon_entropy("raw_content").alias("e")).collect()}
    assert got == pytest.approx(known, abs=1e-6)
    shown = {"": "****", "12345678": "****", "123456789": "1234****6789", "😀😀😀😀😀😀😀😀z": "😀😀😀😀****😀😀😀z"}
    df = spark.createDataFrame([(t,) for t in shown], "raw_content string")
    assert {r.raw_content: r.r for r in df.select("raw_content", text.redact("raw_content").alias("r")).collect()} == shown


def test_platform(docs):
    hay = docs.withColumn("_c", classify.haystack("raw_content", "url")).withColumn("_s", classify.platform_scores("_c"))
    got = {r.seq: (r.b.platform, r.b.confidence) for r in hay.select("seq", classify.best_platform("_s").alias("b")).collect()}
    known = {
        17: ("openai", 0.33), 28: ("openai", 0.33), 29: ("openai", 0.33),
        34: ("claude", 0.4), 35: ("crewai", 0.8), 36: ("cursor", 0.25),
    }
    assert [got[i] for i in range(len(TEXTS))] == by_text(known, ("unknown", 0.0))


def test_tie_goes_to_the_earlier_platform_and_full_house_is_certain(spark):
    rows = [(1, "u", "claude openai", None), (2, "u", " ".join(p.replace("\\", "") for p in cat.PLATFORM_PATTERNS["claude"]), None),
            (3, "https://x/CLAUDE.md", "nothing", None)]
    got = values(enrich.classify_docs(spark.createDataFrame(rows, "seq int, url string, raw_content string, error string"))
                 .select("seq", F.struct("platform", "confidence").alias("p")), "p")
    assert got[1].platform == "claude" and tuple(got[2]) == ("claude", 1.0) and got[3].platform == "claude"


#: Text -> (rule, line, start, redacted, context) of each finding.
FINDINGS = {
    17: [
        ("openai_api_key", 1, 18, "sk-A****Ab3d", "openai.***********sk-A****Ab3d*"),
        ("hardcoded_api_key_assignment", 1, 7, "api_****b3d'", "openai.api_****b3d'"),
    ],
    18: [
        ("openai_api_key", 1, 0, "sk-A****3dsk", "sk-A****3dsk-Ab3dAb3dAb3dAb3dAb3"),
        ("github_token", 1, 79, "ghp_****9Zx9", "b3dAb3dAb3dAb3dAb3d ghp_****9Zx9"),
    ],
    19: [
        ("github_token", 1, 0, "ghp_****9Zx9", "ghp_****9Zx9 " + "*" * 19),
        ("github_token", 1, 41, "ghp_****Q7Q7", "*" * 19 + " ghp_****Q7Q7"),
        ("aws_access_key", 1, 81, "AKIA****Q7Q7", "*" * 20 + "AKIA****Q7Q7"),
    ],
    20: [
        ("aws_access_key", 1, 3, "akia****q7q7", "id=akia****q7q7 and " + "*" * 15),
        ("aws_access_key", 1, 28, "AKIA****Q7Q7", "*" * 15 + " and AKIA****Q7Q7"),
    ],
    21: [("aws_secret_key", 1, 0, 'aws_****J4+"', 'aws_****J4+"')],
    22: [("aws_secret_key", 1, 0, "AWS-****abCD", "AWS-****abCD")],
    23: [("google_api_key", 1, 2, "AIza****_k3_", "K=AIza****_k3_")],
    25: [
        ("huggingface_token", 1, 0, "hf_H****7Hf7", "hf_H****7Hf7 " + "*" * 19),
        ("huggingface_token", 1, 40, "HF_H****7Hf7", "*" * 19 + " HF_H****7Hf7"),
    ],
    26: [("langsmith_api_key", 1, 0, "ls__****q8q8", "ls__****q8q8")],
    27: [
        ("hardcoded_api_key_assignment", 1, 0, 'auth****0k."', 'auth****0k." ' + "*" * 19),
        ("hardcoded_api_key_assignment", 1, 36, "api-****zzz'", "*" * 19 + " api-****zzz'"),
    ],
    28: [
        ("placeholder_leak", 1, 0, "{{ O****Y }}", "{{ O****Y }}********** {{other}}"),
        ("placeholder_leak", 1, 20, "{{CL****DE}}", "*" * 20 + "{{CL****DE}} {{other}}"),
    ],
    29: [
        ("env_var_exposure", 1, 0, "os.e****KEY'", "os.e****KEY'] " + "*" * 18),
        ("env_var_exposure", 1, 29, 'proc****AME"', "*" * 18 + "] proc****AME\") getenv('SHORT')"),
    ],
    30: [("high_entropy_secret", 2, 0, "0123****_-+=", "0123****_-+=")],
    31: [
        ("anthropic_api_key", 1, 4, "sk-a****a1B2", "****sk-a****a1B2"),
        ("high_entropy_secret", 1, 0, "ANT=****a1B2", "ANT=****a1B2"),
    ],
    32: [("openai_api_key", 1, 30, "sk-A****Ab3d", "é" * 20 + "sk-A****Ab3d" + "😀" * 20)],
}


def shown(findings):
    return [(f.rule, f.line, f.start, f.redacted, f.context) for f in findings]


def test_findings(docs):
    got = values(enrich.scan_secrets(docs), "findings")
    assert [shown(got[i]) for i in range(len(TEXTS))] == by_text(FINDINGS, [])
    assert all(f == [] for f in values(enrich.scan_secrets(docs, ()), "findings").values())


def test_custom_rules(spark):
    rules = (
        cat.SecretRule("anchored", r"^plain\b", "line start"),
        cat.SecretRule("number", r"\d{2,}", "digits"),
        cat.SecretRule("name", r"K\w+", "folded", ignore_case=True),
    )
    text = "plain 12 a 345\nnot plain\nkey and KEY plain"
    found = enrich.scan_secrets(spark.createDataFrame([(0, text)], "seq int, raw_content string"), rules).first().findings
    assert [(f.rule, f.line, f.start) for f in found] == [
        ("anchored", 1, 0), ("number", 1, 6), ("number", 1, 11), ("name", 3, 0), ("name", 3, 8),
    ]


def test_rules_in_python_syntax(spark):
    rules = (
        cat.SecretRule("number", r"\d{4,}", "digits"),
        cat.SecretRule("named", r"(?P<key>tok)en=(?P<v>\w+)", "named groups", ignore_case=True),
        cat.SecretRule("paired", r"(<)?[A-Z]{4,}(?(1)>)", "closed if opened"),
        cat.SecretRule("again", r"(?P<x>[a-z]{3})-(?P=x)", "reference", min_entropy=1.5),
    )
    text = "TOKEN=ab12345 <WXYZ> <QRST\r\n\nabc-abc aaa-aaa\nnone 1234"
    df = spark.createDataFrame([(0, text), (1, "nothing"), (2, None), (3, "")], "seq int, raw_content string")
    found = {r.seq: shown(r.findings) for r in enrich.scan_secrets(df, rules).collect()}
    assert found == {
        0: [
            ("number", 1, 8, "****", "************ ****** <****"),
            ("number", 4, 5, "****", "none ****"),
            ("named", 1, 0, "TOKE****2345", "TOKE****2345 ****** <****"),
            ("paired", 1, 0, "****", "************ ****** <***"),
            ("paired", 1, 14, "****", "************* **** <****"),
            ("paired", 1, 22, "****", "*********** ****** <****"),
            ("again", 3, 0, "****", "**** aaa-aaa"),
        ],
        1: [], 2: [], 3: [],
    }
    masked = {r.seq: r.raw_content for r in enrich.mask_secrets(df, rules).collect()}
    assert masked[0] == "*" * 13 + " ****** <****\r\n\n******* aaa-aaa\nnone ****" and masked[1] == "nothing"
    # The same findings as Python's own matches.
    for rule in rules[1:]:
        pattern = re.compile(rule.pattern, re.IGNORECASE if rule.ignore_case else 0)
        own = [(n, m.start()) for n, line in enumerate(text.splitlines(), 1) for m in pattern.finditer(line)]
        got = [(line, start) for name, line, start, *_ in found[0] if name == rule.name]
        assert got == (own if rule.name != "again" else own[:1])
    with pytest.raises(ValueError):
        enrich.scan_secrets(df, (cat.SecretRule("empty", r"(?P<a>x)?", "matches nothing"),))


def test_which_patterns_need_python():
    for pattern in (r"(?P<a>x)", r"(x)(?(1)y|z)", r"[[a]x]", r"[a&&b]", r"(?#note)a", r"(?x) a b", r"x{,3}y", r"\N{BULLET}", r"(?a:\w)"):
        assert pyrules.python_only(pattern)
    for pattern in [r.pattern for r in cat.SECRET_RULES] + [r"(?:a|b)+", r"(?i)x", r"(?i:x)", r"\(\?P<a>", r"\[[a-z]", r"(?<=a)b(?!c)", r"[^\]a]"]:
        assert not pyrules.python_only(pattern)


def test_raw_context_is_available_on_request(docs):
    got = values(enrich.scan_secrets(docs, mask_context=False), "findings")
    assert got[20][0].context == "id=" + "akia" + "q7" * 8 + " and " + "AKIA" + "Q7" * 5 + "Q"
    assert got[23][0].context == "K=AIzaSy" + "k3_" * 11
    assert [len(got[i]) for i in range(len(TEXTS))] == [len(FINDINGS.get(i, ())) for i in range(len(TEXTS))]


def test_masked_documents_hold_no_secret(docs):
    got = values(enrich.mask_secrets(docs), "raw_content")
    secrets = {
        17: "Ab3d" * 9, 18: "Zx9" * 12, 19: "Q7" * 8, 20: "Q7" * 8, 21: "wJ4+" * 10, 22: "abCD" * 10, 23: "k3_" * 11,
        25: "Hf7" * 12, 26: "q8" * 16, 27: "t0k." * 5, 28: "OPENAI_API_KEY", 29: "OPENAI_API_KEY", 31: "a1B2" * 6, 32: "Ab3d" * 9,
    }
    for i, t in enumerate(TEXTS):
        assert len(got[i]) == len(t) and len(got[i].splitlines()) == len(t.splitlines())
        assert (got[i] == t) == (i not in FINDINGS)
        assert i not in secrets or (secrets[i] in t and secrets[i] not in got[i])


def test_escapes_are_ported_one_by_one():
    assert regex.java_pattern(r"a\s\\s\Z").endswith(rf"a[{regex.SPACE}]\\s\z")


def test_many_matches_in_one_line(spark):
    line = "{{AWS}} " * 1500 + "end"
    docs = spark.createDataFrame([(0, line)], "seq int, raw_content string")
    got = enrich.scan_secrets(docs).first().findings
    assert [f.start for f in got] == [8 * k for k in range(1500)]


def test_rule_that_matches_nothing_is_refused(docs):
    with pytest.raises(ValueError):
        enrich.scan_secrets(docs, [cat.SecretRule("bad", r"x*", "")])


def test_clean_text_has_no_findings_and_report_counts(docs):
    report = {r.seq: r for r in enrich.secret_report(enrich.scan_secrets(docs), "seq").collect()}
    assert report[1].secret_count == 0 and report[1].has_secrets is False and report[1].findings == []
    assert all(r.secret_count == len(r.findings) for r in report.values())


#: Bucket -> weight of two texts.
PLAIN = {43: 0.223607, 60: 0.447214, 78: 0.447214, 91: 0.223607, 209: 0.447214, 234: 0.223607, 330: 0.223607, 450: 0.447214}


def test_embedding(docs):
    assert everywhere(docs, embedding.tokenize("raw_content"))[1] == ["plain", "text", "without", "anything"]
    assert everywhere(docs, embedding.tokenize("raw_content"))[36] == ["github", "copilot", "and", "cursor", "rules"]
    got = np.array(everywhere(docs, embedding.hash_embed("raw_content")))
    assert np.array_equal(got, everywhere(docs, embedding.hash_embed_expr("raw_content")))
    assert {i: round(float(x), 6) for i, x in enumerate(got[1]) if x} == PLAIN
    norms = np.linalg.norm(got, axis=1)
    assert np.allclose(norms[norms > 0], 1.0, atol=1e-5) and norms[0] == 0


def test_html_elements(spark):
    rows = [
        ("<system>You <b>are</b></system>", ["Youare"]),
        ("<prompt a='1'> x &amp; y <!-- <system>no</system> --></prompt>", ["x & y"]),
        ("<prompt><system>in</system> out</prompt>", ["inout", "in"]),
        ("<INSTRUCTIONS>\n be kind \n</INSTRUCTIONS><systems>no</systems>", ["be kind"]),
        ("<prompt>a<script>var x</script>b</prompt>", ["ab"]),
        ("<prompt><prompt>a</prompt>b</prompt>", ["ab", "a"]),
        ("<system>open to the end <i>of</i> it", ["open to the endofit"]),
        ("<prompt>caf&#233; &#x26; co</prompt>", ["café & co"]),
        ("<div><system>in</div> out</system>", ["in"]),
    ]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").withColumn("h", regex.needle_text("t"))
    got = {r.t: r.v for r in df.select("t", extract.prompt_html_tags("t", "h").alias("v")).collect()}
    assert got == dict(rows)


ODD = ("", "a", "Ab ab_1 ΑΣ İx ıſK ١٢ ①½ é a b \U0001d4b3 漢字", "_ - __", "ſk-", "DO NOT x.\nMuſt not y. refuſe")


def test_bucket_weights_remember_tokens(spark):
    """The weights come from the Arrow form, equal to the SQL form, which hashes every token again."""
    rows = spark.createDataFrame([(t,) for t in (*ODD, None)], "t string")
    both = rows.select(embedding.bucket_weights("t").alias("a"), embedding.bucket_weights_expr("t").alias("b"))
    assert all(r.a == r.b for r in both.collect())
    assert "ArrowEvalPython" in both._jdf.queryExecution().executedPlan().toString()


def test_literals_and_runs_in_one_pass(spark):
    """The tests for literals and for long runs hold exactly where the plain forms do."""
    words = ["sk-", "{{", "ghp_", "gho_", "api_key", "api-key", "a.b[c", "secret", "x^]\\"]
    run = secrets.cat.SECRET_RULES[-1]
    long = "aB3/+=-_" * 5
    texts = [*ODD, *words, *(f"\n{w[:-1]}{w} " for w in words), long, long[1:], f" {long[1:]}", f"é{long}", f"\n{long}\n", f"{long[1:]} {long[1:]}", f"{long[1:]}.{long}x", f"\U0001d4b3{long}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ran = secrets._existence("t", run)
    pattern = regex.sql_literal(r"[A-Za-z0-9+/=\-_]{40,}")
    got = rows.selectExpr("t", f"{regex.contains_any_sql('t', words)} AS some", f"{ran} AS run", f"rlike(t, {pattern}) AS plain").collect()
    assert [r.some for r in got] == [any(w in r.t for w in words) for r in got]
    assert [r.run for r in got] == [r.plain for r in got] and sum(r.run for r in got) == 5
    assert "A-Z" not in ran and "(?<!" not in ran


def test_constraints_are_tried_at_their_starts(spark):
    texts = [*ODD, "we do  not go. NEVER say\nmust avoid donot", "PROHIBITED muſt not refuseſ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", regex.needle_text("t"))
    plain = regex.sql_literal(regex.java_pattern(extract.cat.CONSTRAINT, ignore_case=True))
    got = rows.select(extract.constraints("t", "h").alias("a"), F.expr(f"regexp_extract_all(t, {plain}, 0)").alias("b")).collect()
    assert [r.a for r in got] == [[m.strip()[:150] for m in r.b] for r in got] and sum(len(r.a) for r in got) >= 7


def test_masking_leaves_other_lines_whole(spark):
    """Lines without a finding are not cut into characters."""
    key = "AKIA" + "Q7" * 8
    rows = spark.createDataFrame([(f"one \U0001d4b3\r\n{key} two {key}\n\nthree\x85",)], "raw_content string")
    assert enrich.mask_secrets(rows).first().raw_content == f"one \U0001d4b3\r\n{'*' * 20} two {'*' * 20}\n\nthree\x85"


def test_texts_are_lowered_and_rules_run_once(spark):
    """Findings and masked text are made of the same matches, all literal tests of the same lower case."""
    docs = spark.createDataFrame([(1, "u", "x", None)], "seq bigint, url string, raw_content string, error string")
    plan = enrich.enrich(docs, masked=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lambda") == len(cat.SECRET_RULES)
    assert plan.count("lower(raw_content") == 1


LINE_ENDS = ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def test_masking_keeps_every_line_end(spark):
    """First, last, neighbouring and repeated lines with findings, behind each kind of line end."""
    key, star = "AKIA" + "Q7" * 8, "*" * 20
    shapes = ("K", "K|", "|K", "a|K|K||b|", "K|a|K|aK", "||K||", "a|b")
    texts = [s.replace("|", end).replace("K", key) for s in shapes for end in LINE_ENDS] + [f"{key}\n{key}\r\n\r{key}\u2028a\n"]
    rows = spark.createDataFrame([(i, "u", t, None) for i, t in enumerate(texts)], "seq bigint, url string, raw_content string, error string")
    for r in enrich.enrich(rows, masked=True).collect():
        assert (r.masked_content or r.raw_content) == texts[r.seq].replace(key, star)
        assert r.has_secrets == (r.masked_content is not None) == (key in texts[r.seq])
        lines = re.split(r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", texts[r.seq])
        assert [f.line for f in r.findings] == [n for n, line in enumerate(lines, 1) if key in line]


def test_embedder_never_hashes_a_frequent_token_again(monkeypatch):
    """Its memory is set aside when it is full; what is still in use is taken over."""
    hashed = []
    real = embedding.hashlib.md5
    monkeypatch.setattr(embedding.F, "arrow_udf", lambda f, _: f)
    monkeypatch.setattr(embedding.hashlib, "md5", lambda data: hashed.append(data) or real(data))
    embed = embedding._arrow_embedder(512, False, remembered=4)
    texts = ["often " + " ".join(f"w{i}{j}" for j in range(3)) for i in range(20)] + ["É_1 often\x1cÉ_1 İ", None]
    rows = embed(pa.array(texts)).to_pylist()
    assert hashed.count(b"often") == 1
    assert rows[-1] is None and sum(rows[-2]) == 1.5 * 4 and sum(rows[0]) == 1.5 * 4

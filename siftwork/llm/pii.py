"""Personal data replaced by surrogates of the same kind.

Detected are e-mail addresses, bank accounts (IBAN with its check digits), payment cards (issuer prefix
and check digit), IPv4 and IPv6 addresses, telephone numbers (with + and country code, in the North
American format, or with a trunk zero and spaces; not a national number in pairs of digits, which looks
like any list of numbers), US social security numbers (with hyphens, or with spaces behind their name),
secrets behind a key word or in the format of a provider, passwords behind a key word (letters and
others), and names behind a title, wherever these stand again in the text with a capital.  Particles
between names (van, de) and suffixes (Jr.) stay; an initial becomes another letter and is no entity.
A surrogate is drawn from a keyed hash of the entity: the same entity has the same surrogate in
every document, whatever its capitals or separators, and nobody without the key can find it again.
It keeps the format: separators, capitals, number of digits and letters, script of the letters, the
country code and issuer digit, a valid check digit, private addresses private; a given name keeps
the gender that its title tells (the first that a text tells of it).

All distinct entities are compared: a surrogate that another entity has already, or that is itself
an entity of the corpus, is drawn again.  After a few draws in vain the space grows: names get more
syllables, other entities more letters or digits, private addresses another private range and then
the public one, so that a free surrogate is found however many entities there are.  Only entities drawn more than once are joined
back to their documents; texts are rewritten where they are.  A run of symbols behind a key word (a
blank to fill in, a ruler) is not a secret.

Null texts stay null and texts without an entity stay as they are.  All columns are kept; rows may
repeat.  Overlapping finds go to the kind that stands first in `KINDS`."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

KINDS = ("email", "secret", "iban", "card", "ssn", "ip6", "ip", "phone", "given", "family", "initial")
DEFAULT_KEY = "change this key in production"

_LOCAL = re.compile(r"[\w.%+\-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w\-]{0,61}[^\W_])?\.){1,8}[^\W\d_]{2,24}(?![\w\-])")
_CARD = re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)")
_ISSUER = re.compile(r"4|5[1-5]|2(?:2[2-9]|[3-6]|7[01])|3[47]|6(?:011|5)")
_SSN = re.compile(r"(?<![\d\-])(\d{3}-\d{2}-\d{4})(?![\d\-])")
_NAMED_SSN = re.compile(r"(?i)\b(?:SSN|social security(?: number| no\.?)?)[:#]?\s{1,3}(\d{3} \d{2} \d{4})(?!\d)")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)")
_PHONE = re.compile(
    r"(?<![\d+])(?:(?:\+1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}|\+1[ .\-]?\d{3} \d{3} \d{4}"
    r"|\+(?!1[ .\-(])\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4})(?!\d)"
)
_NATIONAL = re.compile(
    r"(?<![\d+])(?:(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|0[1-9]\d{0,3} (?=(?:\d ?){5,9}(?!\d))\d{3,8}(?: \d{2,8}){0,2}(?![.,:\-]?\d))"
)
_RUN = re.compile(r"\d+")
#: A group of digits behind those before it.
_GROUP = re.compile(r"[ .\-/]?\(\d{1,5}\)|(?:(?<=\))[ .\-/]?|[ .\-/])\d+")
_GOES_ON = re.compile(r"[.,:/\-]?\d")
#: The country code: what is set apart, or else by the codes in use; with a trunk zero in brackets.
_COUNTRY = re.compile(
    r"\+(?:\d{1,3}(?=[ .\-/(])|1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})(?:[ .\-/]?\(0\))?"
)
_SECRET = re.compile(
    r"(?i)\b(?:api[_\-]?key|access[_\-]?key|secret|token|password|passwd|pwd)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
    r"((?=[+/_\-=]*[A-Za-z0-9])[A-Za-z0-9+/_\-=]{16,})"
)
#: Secrets by the prefix of their provider, which stays.
_KEY = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:(?:AKIA|ASIA)(?=[0-9A-Z]{16}(?![0-9A-Za-z]))|gh[pousr]_(?=[A-Za-z0-9]{36})|AIza(?=[\w\-]{35})|hf_(?=[A-Za-z0-9]{30})"
    r"|sk-(?=[A-Za-z0-9_\-]{20})|xox[abprs]-(?=[A-Za-z0-9\-]{10}))[A-Za-z0-9_\-]+"
)
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|AIza|hf_|sk-|xox[abprs]-")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AIza", "hf_", "sk-", "xox")
_PASSWORD = re.compile(r"(?i)\b(?:password|passwd|pwd)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?((?=[^\s\"']*[a-z])(?=[^\s\"']*[^a-z\s\"'.,;:!?])[^\s\"']{6,64})")
#: Titles by the gender they tell.
_TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta",
          "Doña", "Signora", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor", "Доктор"),
}
_GENDER = {form: g for g, titles in _TITLES.items() for t in titles for form in (t, t.upper())} | {"M.": "m"}
#: Words inside a name that are not names, and behind one.
_PARTICLES = frozenset("af al bin da das de degli dei del della den der di do dos du el ibn la le los ten ter van vom von y zu zum zur".split())
_SUFFIXES = frozenset("Jr JR Sr II III IV MD PhD Esq".split())
_WORD = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_GAP = r"[^\S\r\n]{1,3}"
_TITLE = re.compile(rf"\b({'|'.join(sorted(map(re.escape, _GENDER), key=len, reverse=True))})(?:(?<=\.)|\b\.?)(?={_GAP})")
_NAME = re.compile(rf"{_GAP}({_WORD})")
_POSSESSIVE = re.compile(r"['’][sS]$")
_ANY = re.compile(rf"[@0-9]|\b(?:{'|'.join(map(re.escape, _GENDER))})(?!\w)|(?i:secret|token|passw|pwd|key)|sk-|hf_|AIza|gh._|xox")

#: Letters of a script, lower case, by a code point range.
_SCRIPTS = {"latin": (0x61, 0x7B), "greek": (0x3B1, 0x3CA), "cyrillic": (0x430, 0x450), "hebrew": (0x5D0, 0x5EB), "arabic": (0x641, 0x64B)}
_ALPHABET = {s: "".join(c for c in map(chr, range(a, b)) if c.isalpha() and c != "ς") for s, (a, b) in _SCRIPTS.items()}
#: First octets of addresses in no special range.
_PUBLIC = [n for n in range(11, 224) if n not in (100, 127, 169, 172, 192, 198, 203)]
_HAN = (0x4E00, 0x9FA5)
#: Draws before the space of surrogates grows; numbers and addresses have a format that is worth more of them.
_PATIENCE = {"card": 12, "ssn": 12, "phone": 12, "ip": 24}
#: Sounds that invented names are made of, and endings that tell a gender.
_ONSETS = {"latin": "b c d f g h j k l m n p r s t v w z br cl dr gr st tr".split(), "greek": list("βγδζθκλμνπρστφχ"), "cyrillic": list("бвгджзклмнпрстфхчш")}
_VOWELS = {"latin": "a e i o u ai ea ou".split(), "greek": list("αεηιουω"), "cyrillic": list("аеиоуя")}
_ENDINGS = {
    "latin": {"m": ("o", "an", "us", "ert"), "f": ("a", "ia", "ine", "elle"), "n": ("in", "en", "el", "is")},
    "greek": {"m": ("ος", "ης"), "f": ("α", "η"), "n": ("ι", "υ")},
    "cyrillic": {"m": ("ан", "ир"), "f": ("а", "ия"), "n": ("ин", "ей")},
}

Span = tuple[int, int, str, str]  # begin, end, kind (with gender for given names), canonical form


# ----------------------------------------------------------------------------------- detection


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def _emails(text: str) -> Iterator[Span]:
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            begin = local.start() + len(local[0]) - len(local[0].lstrip(".-%+"))
            if begin < at:
                yield begin, domain.end(), "email", text[begin : domain.end()].lower()
        at = text.find("@", at + 1)


def _international(text: str, at: int) -> int | None:
    """End of the telephone number whose + stands before `at`: 7 to 15 digits, as many groups as go
    together.  Compact numbers and runs of seven digits end it, but for an extension behind a hyphen;
    numbers of country 1 have eleven digits."""
    first = _RUN.match(text, at)
    if first is None:
        return None
    if len(first[0]) > 4:
        before, behind = text[max(0, at - 2) : at - 1], text[first.end() : first.end() + 1]
        inside = (before.isascii() and before.isalnum()) or (behind.isascii() and behind.isalpha() and behind not in "xX")
        return first.end() if 7 <= len(first[0]) <= 15 and not inside else None
    digits, end, best, dots, run = len(first[0]), first.end(), None, None, 0
    while group := _GROUP.match(text, end):
        n = len(_digits(group[0]))
        if digits + n > 15 or (run > 6 and group[0][0] != "-"):
            break
        if group[0][0] == "." and dots is False:
            break
        dots = group[0][0] == "." if dots is None or group[0][0] != "." else dots
        digits, end, run = digits + n, group.end(), max(run, n)
        if digits >= 7 and text[end - 1] != ")" and (digits == 11 or first[0] != "1") and not _GOES_ON.match(text, end):
            best = end
    return best


def _phones(text: str) -> Iterator[Span]:
    ends = {m.start(): m.end() for m in _PHONE.finditer(text)}
    for m in _NATIONAL.finditer(text):
        ends[m.start()] = max(m.end(), ends.get(m.start(), 0))
    at = text.find("+")
    while at >= 0:
        if not text[max(0, at - 1) : at].isdecimal() and text[max(0, at - 1) : at] != "+" and (end := _international(text, at + 1)):
            ends[at] = max(end, ends.get(at, 0))
        at = text.find("+", at + 1)
    for begin, end in ends.items():
        yield begin, end, "phone", _digits(_COUNTRY.sub("", text[begin:end], 1))


def _name_words(text: str, at: int) -> Iterator[tuple[int, int, str]]:
    """Words of a name from a place on: (begin, end, name, initial or particle).  A particle counts if
    a name follows it; possessive endings are no part of a name."""
    held: list[tuple[int, int, str]] = []
    while word := _NAME.match(text, at):
        own = _POSSESSIVE.sub("", word[1])
        begin, at = word.start(1), word.start(1) + len(own)
        if own in _PARTICLES:
            held.append((begin, at, "particle"))
            continue
        if not own[0].isupper() or own in _GENDER or own in _SUFFIXES:
            return
        initial = len(own) == 1 and text[at : at + 1] == "."
        yield from held
        held = []
        yield begin, at, "initial" if initial else "name"
        at += initial
        if own != word[1]:
            return


def _names(text: str) -> Iterator[Span]:
    """Names behind a title: given names and, last or behind a particle, family names; and the same
    words with a capital elsewhere in the text."""
    known: dict[str, str] = {}
    spans: list[tuple[int, int, str]] = []
    for title in _TITLE.finditer(text):
        words = list(_name_words(text, title.end()))
        names = [k for k, w in enumerate(words) if w[2] == "name"]
        cut = min([k for k, w in enumerate(words) if w[2] == "particle" and any(n < k for n in names)] or names[-1:] or [0])
        for k, (begin, end, part) in enumerate(words):
            if part == "particle":
                continue
            kind = part if part == "initial" else "family" if k >= cut else f"given:{_GENDER[title[1]]}"
            entity = text[begin:end].casefold()
            if kind != "initial" and (entity not in known or known[entity] == "given:n" != kind):
                known[entity] = kind
            spans.append((begin, end, kind))
    for begin, end, kind in spans:
        entity = text[begin:end].casefold()
        yield begin, end, kind if kind == "initial" else known[entity], entity
    if known:
        again = "|".join(re.escape(e) for e in sorted(known, key=len, reverse=True))
        for word in re.finditer(rf"(?i)(?<!\w)(?:{again})(?!\w)", text):
            if word[0][0].isupper() and (entity := word[0].casefold()) in known:
                yield word.start(), word.end(), known[entity], entity


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _accounts(text: str) -> Iterator[Span]:
    """Account numbers whose check digits are right; a group too many at the end is left out."""
    for m in _IBAN.finditer(text):
        found = "" if text[max(0, m.start() - 1) : m.start()].isalnum() else m[0]
        while found:
            own = found.replace(" ", "")
            if 15 <= len(own) <= 34 and _mod97(own) == 1:
                yield m.start(), m.start() + len(found), "iban", own
                break
            found = found.rpartition(" ")[0]


def _addresses6(text: str) -> Iterator[Span]:
    for m in _IP6.finditer(text):
        if m[0].count(":") > 2 and any(c.isdecimal() for c in m[0]):
            try:
                yield m.start(), m.end(), "ip6", str(ipaddress.IPv6Address(m[0]))
            except ValueError:
                continue


def _secrets(text: str) -> Iterator[Span]:
    if "=" in text or ":" in text:
        for pattern in (_SECRET, _PASSWORD):
            yield from ((m.start(1), m.end(1), "secret", m[1]) for m in pattern.finditer(text))
    if any(p in text for p in _PREFIXES):
        yield from ((m.start(), m.end(), "secret", m[0]) for m in _KEY.finditer(text))


def find(text: str | None) -> list[Span]:
    """Entities of a whole text in order, without overlaps."""
    if not text or not _ANY.search(text):
        return []
    found: list[tuple[int, Span]] = []

    def add(spans) -> None:
        found.extend((KINDS.index(s[2].partition(":")[0]), s) for s in spans)

    if "@" in text:
        add(_emails(text))
    add(_secrets(text))
    add(_accounts(text))
    if _COLONS.search(text):
        add(_addresses6(text))
    cards = ((m.start(), m.end(), "card", _digits(m[0])) for m in _CARD.finditer(text))
    cards = (c for c in cards if _ISSUER.match(c[3]) and _luhn(c[3]) == 0)
    add(c for c in cards if text[max(0, c[0] - 1) : c[0]] != "+" or not _international(text, c[0]))
    for pattern in (_SSN, _NAMED_SSN) if "SSN" in text or "ssn" in text or "ocial" in text else (_SSN,):
        add((m.start(1), m.end(1), "ssn", _digits(m[1])) for m in pattern.finditer(text))
    add((m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text) if all(int(x) < 256 for x in m[0].split(".")))
    add(_phones(text))
    add(_names(text))
    kept: list[Span] = []
    taken = bytearray(0)
    if len(found) > 1:
        taken = bytearray(len(text))
    for _, span in sorted(found):
        if not taken or not any(taken[span[0] : span[1]]):
            kept.append(span)
            if taken:
                taken[span[0] : span[1]] = b"\1" * (span[1] - span[0])
    return sorted(kept)


# ---------------------------------------------------------------------------------- generation


class _Draws:
    """An endless keyed series of numbers for one entity."""

    def __init__(self, key: str, kind: str, entity: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\0{entity}\0{attempt}".encode(), key=hashlib.sha256(key.encode()).digest()).digest()
        self.pool, self.round = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.seed + self.round.to_bytes(4, "little")).digest()
            self.round += 1
        value, self.pool = int.from_bytes(self.pool[:4], "little"), self.pool[4:]
        return value % n

    def pick(self, options):
        return options[self.below(len(options))]


def _script(char: str) -> str | None:
    low = char.lower()[:1]
    if low.isascii() or "\xdf" <= low <= "ɏ":
        return "latin"
    return next((s for s, (a, b) in _SCRIPTS.items() if a <= ord(low) < b), "han" if _HAN[0] <= ord(low) <= _HAN[1] else None)


@lru_cache(None)
def _neighbours(script: str, block: int) -> str:
    """Letters without capitals of a script that has no alphabet here, from a block of 1,024 code points."""
    near = map(chr, range(block << 10, (block + 1) << 10))
    return "".join(c for c in near if c.isalpha() and c == c.lower() and unicodedata.name(c, "").partition(" ")[0] == script)


def _letter(char: str, draws: _Draws) -> str:
    """A letter of the same script and case."""
    script = _script(char)
    if script == "han":
        return chr(draws.below(_HAN[1] - _HAN[0]) + _HAN[0])
    low = char.lower()[:1]
    letters = _ALPHABET[script] if script else _neighbours(unicodedata.name(low, "").partition(" ")[0], ord(low) >> 10)
    new = draws.pick(letters or _ALPHABET["latin"])
    return new.upper() if char.isupper() and len(new.upper()) == 1 else new


def _alike(text: str, draws: _Draws, more: int = 0) -> str:
    """Letters for letters of the script, digits for digits, all else as it is; then `more` like the last one."""
    out, last = [], "a"
    for c in text:
        if c.isdecimal():
            out.append(str(draws.below(10)))
        elif c.isalpha():
            out.append(_letter(c, draws))
        else:
            out.append(c)
            continue
        last = c
    out += [str(draws.below(10)) if last.isdecimal() else _letter(last, draws) for _ in range(more)]
    return "".join(out)


def _number(text: str, draws: _Draws, keep: int = 0, more: int = 0) -> str:
    """Digits of the same number and `more`, the first `keep` ones as they are; a leading zero may be one again."""
    return text[:keep] + "".join(
        str(draws.below(10)) if i or c == "0" else str(1 + draws.below(9)) for i, c in enumerate(text[keep:] + "0" * more)
    )


def _name(entity: str, kind: str, draws: _Draws, more: int = 0) -> str:
    script = _script(entity[0])
    if script not in _ONSETS:
        return _alike(entity, draws, more)
    syllable = lambda: draws.pick(_ONSETS[script]) + draws.pick(_VOWELS[script])
    longer = "".join(syllable() for _ in range(more))
    if kind == "family":
        return longer + syllable() + syllable() + draws.pick(_ONSETS[script]) + draws.pick(_ENDINGS[script]["n"])
    return longer + syllable() + draws.pick(_ONSETS[script]) + draws.pick(_ENDINGS[script][kind.partition(":")[2] or "n"])


def surrogate(kind: str, entity: str, attempt: int, key: str) -> str:
    """Canonical surrogate of a canonical entity; later attempts draw from ever larger spaces."""
    draws = _Draws(key, kind.partition(":")[0], entity, attempt)
    more = max(0, attempt - _PATIENCE.get(kind, 3))
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels, _, top = domain.rpartition(".")
        return f"{_alike(local, draws, more)}@{_alike(labels, draws)}.{top}"
    if kind == "card":
        body = _number(entity[:-1], draws, keep=1, more=more)
        return body + str(-_luhn(body + "0") % 10)
    if kind == "ip":
        octets = entity.split(".")
        keep = (1 if octets[0] in ("10", "127") else 2) if ipaddress.ip_address(".".join(str(int(o)) for o in octets)).is_private else 0
        head = octets[:keep] or [str(draws.pick(_PUBLIC))]
        if attempt > 3 and keep:  # another private range, the largest, and at last a public one
            head = ["10"] if attempt <= 12 else [str(draws.pick(_PUBLIC))]
        return ".".join([*head, *(str(1 + draws.below(254)) for _ in range(4 - len(head)))])
    if kind == "ip6":  # the first group tells the range; groups of zeros stay
        groups = ipaddress.IPv6Address(entity).exploded.split(":")
        new = [g if i == 0 or g == "0000" and attempt < 8 else f"{1 + draws.below(65535):04x}" for i, g in enumerate(groups)]
        return str(ipaddress.IPv6Address(":".join(new)))
    if kind == "iban":
        body = _alike(entity[4:], draws, more).upper()
        return f"{entity[:2]}{98 - _mod97(entity[:2] + '00' + body):02d}{body}"
    if kind == "initial":
        return _letter(entity[0], draws)
    if kind in ("phone", "ssn"):
        return _number(entity, draws, keep=int(kind == "phone" and entity[0] == "0"), more=more)
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity):
            hexes = "0123456789ABCDEF" if entity.isupper() else "0123456789abcdef"
            return "".join(draws.pick(hexes) for _ in range(len(entity) + more))
        prefix = _PREFIX.match(entity)
        kept = prefix.end() if prefix else 0
        return entity[:kept] + _alike(entity[kept:], draws, more)
    return _name(entity, kind, draws, more)


def _like_mention(kind: str, mention: str, new: str) -> str:
    """The canonical surrogate in the format of a mention."""
    if kind in ("card", "phone", "ssn"):
        digits, country = iter(new), _COUNTRY.match(mention)
        kept = country.end() if country else 0
        return mention[:kept] + "".join(next(digits) if c.isdecimal() else c for c in mention[kept:]) + "".join(digits)
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in mention) + "".join(letters)
    if kind == "email" and len(new) == len(mention):
        return "".join(n.upper() if m.isupper() else n for m, n in zip(mention, new, strict=True))
    if kind in ("family", "initial") or kind.startswith("given"):
        return new.upper() if len(mention) > 1 and mention.isupper() else new[:1].upper() + new[1:]
    return new


def replace(text: str | None, key: str, attempts: dict[tuple[str, str], int] | None = None) -> str | None:
    """The text with surrogates; `attempts` has the draws of (kind, entity) that were drawn again."""
    if text is None or not (spans := find(text)):
        return text
    out, at = [], 0
    for begin, end, kind, entity in spans:
        attempt = (attempts or {}).get((kind, entity), 0)
        out += [text[at:begin], _like_mention(kind, text[begin:end], surrogate(kind, entity, attempt, key))]
        at = end
    return "".join([*out, text[at:]])


# --------------------------------------------------------------------------------------- Spark


def _entities() -> Column:
    @F.arrow_udf("array<struct<kind:string,entity:string>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [sorted({(s[2], s[3]) for s in find(t.as_py()) if s[2] != "initial"}) for t in texts]
        return pa.array([[{"kind": k, "entity": e} for k, e in r] for r in rows], pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string())])))

    return found(F.col("text"))


def resolve(entities: DataFrame, work: Workspace, key: str) -> DataFrame | None:
    """(class, kind, entity, attempt) of the entities whose first surrogate won't do; None if none.

    Round by round: of the entities that draw one surrogate the first in order keeps it, unless it
    is an entity itself or settled before; the others draw again.  `entities` has one row per
    (class, kind, entity): a given name under two kinds has two surrogates."""
    key_columns = ["class", "kind", "entity"]

    @F.arrow_udf("string")
    def draw(kind: pa.Array, entity: pa.Array, attempt: pa.Array) -> pa.Array:
        rows = zip(kind.to_pylist(), entity.to_pylist(), attempt.to_pylist(), strict=True)
        return pa.array([surrogate(k, e, a, key) for k, e, a in rows], pa.string())

    originals = entities.select("class", F.col("entity").alias("new")).distinct()
    pending, settled, redrawn = entities.withColumn("attempt", F.lit(0)), None, None
    while True:
        drawn = work.keep(pending.withColumn("new", draw("kind", "entity", "attempt")))
        free = drawn.join(originals, ["class", "new"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["class", "new"], "left_anti")
        first = free.groupBy("class", "new").agg(F.min(F.struct("entity", "kind")).alias("e")).select("class", "new", "e.*")
        won = work.keep(drawn.join(first, [*key_columns, "new"], "left_semi"))
        settled = won.select("class", "new") if settled is None else work.keep(settled.unionByName(won.select("class", "new")))
        again = won.filter("attempt > 0").select(*key_columns, "attempt")
        redrawn = again if redrawn is None else redrawn.unionByName(again)
        lost = drawn.join(won.select(*key_columns), key_columns, "left_anti")
        pending = work.keep(lost.select(*key_columns, (F.col("attempt") + 1).alias("attempt")))
        if pending.isEmpty():
            break
    redrawn = work.keep(redrawn)
    return None if redrawn.isEmpty() else redrawn


def with_surrogates(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """The documents (doc_id, text, ...) with `text` rewritten."""
    work = Workspace(docs.sparkSession)
    own = [F.xxhash64("text").alias("_hash"), F.col("doc_id").alias("_doc")]
    mentions = docs.select(*own, F.explode(_entities()).alias("_e")).select("_hash", "_doc", "_e.*")
    mentions = work.keep(mentions.withColumn("class", F.split_part("kind", F.lit(":"), F.lit(1))))
    entities = mentions.select("class", "kind", "entity").distinct()
    redrawn = resolve(work.keep(entities), work, key)

    @F.arrow_udf("string")
    def rewritten(texts: pa.Array) -> pa.Array:
        return pa.array([replace(t.as_py(), key) for t in texts], pa.string())

    if redrawn is None:
        return docs.withColumn("text", rewritten("text"))

    @F.arrow_udf("string")
    def rewritten_with(texts: pa.Array, again: pa.Array) -> pa.Array:
        known = ({(a["kind"], a["entity"]): a["attempt"] for a in x.as_py() or ()} for x in again)
        return pa.array([replace(t.as_py(), key, k) for t, k in zip(texts, known, strict=True)], pa.string())

    again = (
        mentions.join(redrawn, [c for c in ("class", "kind", "entity") if c in redrawn.columns])
        .groupBy("_hash", "_doc")
        .agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("_again"))
    )
    again = work.keep(again)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("_own"))
    same = (rows["_own"] == again["_hash"]) & rows["row.doc_id"].eqNullSafe(again["_doc"])
    joined = rows.join(again, same, "left")
    new = [rewritten_with("row.text", "_again").alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns]
    return joined.select(*new)

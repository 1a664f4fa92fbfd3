"""Personal data and secrets replaced by surrogates of the same kind, form, gender and script.

:func:`detect` finds entities of a text; each has a kind and a normal form, so
that a telephone number is the same entity with and without brackets. A
surrogate is a keyed function (HMAC-SHA256) of kind and normal form, so all
mentions of an entity in all documents get the same one, without any table of
entities. Digits go through a keyed permutation of the numbers of that length,
which keeps different numbers different; check digits stay right or wrong;
case, separators and brackets are those of the mention; names keep the gender
of their title and their script.

Telephone numbers are found with a country code, a bracketed area code, a
leading zero (in groups, or 10 to 12 digits), as 3-3-4, and as nine digits from
6 on in groups; cards in groups of four, and with 13 to 19 digits by their check digit.

A name is found behind a title or several, with any number of parts, initials and
particles, and then at every mention in that document, also of one part of it and with
a genitive ending; a lone part that the document also writes small only where it
stands by a title or its other part. A title is never a name; particles stay. Given and
family names are entities of their own; the parts before the last are given names, but
for the last two behind a Spanish title. Initials go through a keyed permutation of the
alphabet. A title that tells no gender takes it from the given name's other titles in the
document; where only other documents tell it, the given names differ in their last letters.
An address whose local part has several words takes their surrogates as names.

Distinctness is then checked over the whole corpus: entities whose surrogates
meet, or whose surrogate is itself an entity of the corpus, are tried again with
another count in the key, all but the first of each meeting, until none meets.
Only these exceptions (a handful, as the spaces are large) are handed to the
workers, as a broadcast below a checked size and by a join above it.

Defined results: NULL and empty texts stay as they are; repeated rows get the
same replacement; all other columns pass through. Calling :func:`replace`
starts jobs.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import query, table, texts_in_blocks, written

#: Exceptions that may be broadcast.
BROADCAST_LIMIT = 200_000
ROUNDS = 16

# Titles by gender, as they are written before names.
TITLES = {
    "m": ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Don", "господин", "г-н", "κύριος"),
    "f": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Doña", "госпожа", "г-жа", "κυρία"),
    "n": ("Dr.", "Prof."),
}
_GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}
# Titles before names that end in two family names; what stands between the parts of a name; what follows a name.
_TWO_FAMILIES = {"Señor", "Sr.", "Don", "Señora", "Sra.", "Doña"}
_PARTICLE = r"(?:(?:[Vv]on|[Vv]an|[Dd]e)(?: und zu| zu| dem| der| den| la| las| los| le)?|[Dd]el|[Dd]ella|du|di|da|dos|das|bin|ter|ten|af|av)"
_SUFFIX = r"Jr|Sr|II|III|IV|PhD|MD|Esq"
_DEGREE = r"(?:(?:med|phil|rer|nat|jur|iur|theol|oec|pol|dent|vet|h\. ?c|-?Ing)\. ?)"
# Letters of initials, by script.
_ALPHABETS = {"LATIN": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "CYRILLIC": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "GREEK": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
# Syllables and endings for made-up names, by script.
_SYLLABLES = {
    "LATIN": ("ba be bi bo bu da de di do du fa fe fi fo ga ge gi go ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
              {"m": "n", "f": "a", "n": "l"}, "er"),
    "CYRILLIC": ("ба бе би бо да де ди до га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split(),
                 {"m": "н", "f": "а", "n": "ль"}, "ов"),
    "GREEK": ("βα βε βι βο δα δε δι δο γα γε γι γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
              {"m": "ς", "f": "α", "n": "ν"}, "ης"),
}

_TITLE = "|".join(sorted((re.escape(t) for t in _GENDER), key=len, reverse=True))
_UPPER = "[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]"
_PHONES = (
    # country code: by plan, then any, of up to 15 digits or so; a lone digit only right after the code
    r"(?<![\w.])\+33[ .-]?(?:\(0\)[ .-]?)?[1-9](?:[ .-]?\d\d){4}(?!\w)",
    r"(?<![\w.])\+34(?:[ .-]?\d){9}(?!\w)",
    r"(?<![\w.])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
    r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\d(?=[ .-]\d\d))?(?:(?:[ ./-](?=\d\d))?\d){6,13}(?!\w)",
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}(?:[ .-]?\d{2,4}){1,2}(?!\w)",
    r"(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)",
    # bracketed area code before pairs
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(0\d{1,4}\)[ .-]?\d\d(?:[ .-]?\d\d){2,4}(?!\w)",
    # 3-3-4
    r"(?<![\w.])(?<!\d[,/-])(?:1[ .-])?\d{3}(?P<a>[ .-])\d{3}(?P=a)\d{4}(?!\w)",
    # leading zero, but no dates; without separators 10 to 12 digits
    r"(?<![\w.+])(?<!\d[,/-])(?!\d\d(?P<d>[ ./-])\d\d(?P=d)\d{4}(?!\w))0[1-9](?:[ .-]\d\d){4}(?!\w)",
    r"(?<![\w.+])(?<!\d[,/-])(?!\d\d(?P<e>[ ./-])\d\d(?P=e)\d{4}(?!\w))(?!\d{4}-\d\d-\d\d(?!\w))"
    r"(?=0\d+(?: ?/ ?|[ .-])\d|\d{10,12}(?!\w))0[1-9](?:(?:(?: ?/ ?|[ .-])(?=\d\d))?\d){6,11}(?!\w)",
    # nine digits, from 6 on: 3-3-3 (no amounts), 3-2-2-2, 2-3-2-2
    r"(?<![\w.€$£+])(?<!\d[ ,/-])[6-9]\d\d(?P<f>[ .-])\d{3}(?P=f)\d{3}(?!\w|[ .,]\d| ?[€$£%])",
    r"(?<![\w.])(?<!\d[,/-])(?:[6-9]\d\d(?P<g>[ .-])\d\d|[89]\d(?P<h>[ .-])\d{3})(?:(?:(?P=g)|(?P=h))\d\d){2}(?!\w)",
)
PATTERNS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]*[\w%+-]@[\w-]+(?:\.[\w-]+)+")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\w)")),
    ("card", re.compile(
        r"(?<![\w.])[2-6]\d{3}(?:(?P<c>[ -])(?:\d{6}(?P=c)\d{4,5}|\d{4}(?P=c)\d{5}|\d{4}(?P=c)\d{4}(?P=c)\d|(?:\d{4}(?P=c)){3}\d{1,3})|\d{9,15})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    *(("phone", re.compile(p)) for p in _PHONES),
    ("secret", re.compile(r"-----BEGIN (?P<of>[A-Z ]*)PRIVATE KEY(?: BLOCK)?-----(?P<value>[^-]+(?:-(?!----)[^-]*)*)-----END (?P=of)PRIVATE KEY")),
    ("secret", re.compile(r"(?<![\w-])eyJ[\w-]{8,}\.[\w-]{4,}\.[\w-]*")),
    ("secret", re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}|(?:gh[opsu]_|sk-|xox[abp]-)[\w-]{16,})(?!\w)")),
    ("secret", re.compile(r"(?i)(?<!\w)(?:password|passwd|pwd|token|secret|api[_-]?key)\s?[=:]\s?[\"']?(?P<value>[\w/+.~-]{6,})")),
)
# A part begins with a capital that nothing of its word precedes, but for an elided particle.
_START = rf"(?<![\w-])(?:(?<!\w['’])|(?<=\b[dD]['’])){_UPPER}"
_PART = rf"(?!(?:{_TITLE}|{_SUFFIX})(?!\w)){_START}[\w’'-]+"
_INITIAL = rf"(?<!\w){_UPPER}\."
_BETWEEN = rf"(?:{_PARTICLE}[ \u00a0]|[dD]['’])*"
_TITLED = re.compile(
    rf"(?<!\w)(?P<titles>(?:(?:{_TITLE})[ \u00a0]{_DEGREE}*)+)"
    rf"(?P<value>{_BETWEEN}(?:(?:{_INITIAL}[ \u00a0-]?|{_PART}[ \u00a0]){_BETWEEN})*{_PART}|{_INITIAL})")
_ONE_TITLE = re.compile(_TITLE)
_CAPITAL = re.compile(_PART)
_SMALL = re.compile(r"(?<![\w’-])[^\W\d_A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][\w’-]+")
# What may stand between two parts of one name, and an initial at the end of a stretch.
_GAP = re.compile(rf"[ \u00a0](?:{_INITIAL}[ \u00a0-]?)*{_BETWEEN}")
_LAST_INITIAL = re.compile(rf"{_INITIAL}(?=[ \u00a0-]?{_BETWEEN}$)")
_JOINED = re.compile(rf"[ \u00a0-]{_BETWEEN}")
_INITIAL_JOINED = re.compile(rf"\.[ \u00a0-]?{_BETWEEN}")
# What a text must hold for a pattern to be tried at all.
_NEEDED = {"email": re.compile("@"), "name": re.compile(_TITLE), "secret": re.compile("[=:_-]|AKIA|eyJ"), "": re.compile(r"\d"),
           "ip": re.compile(r"\d\.\d|:[0-9A-Fa-f:]*:")}
_PREFIX = re.compile(r"AKIA|gh[opsu]_|sk-|xox[abp]-|eyJ")
# Address words that are replaced like the parts of a name.
_NAME_ADDRESS = re.compile(r"[^\W\d_]+(?:[._-][^\W\d_]+)+")


def script_of(name: str) -> str:
    letter = next((c for c in name if c.isalpha()), "A")
    script = unicodedata.name(letter, "LATIN").split(" ")[0]
    return script if script in _SYLLABLES else "LATIN"


def _normal(kind: str, value: str) -> str:
    if kind in ("phone", "card", "ssn"):
        value = value.replace("(0)", "") if kind == "phone" else value
        return ("+" if value[0] == "+" else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip" and ":" in value:
        return str(ipaddress.IPv6Address(value))
    return value.casefold() if kind == "email" else value


def _bare(word: str) -> str:
    """A part without an ending that its sentence gave it."""
    return (word[:-2] if word[-2:] in ("’s", "'s") else word).rstrip("’'-")


def _name(word: str) -> str:
    return word.casefold().replace("’", "'")


def _titled_names(text: str) -> tuple[dict[str, set[str]], set[str], dict[int, str], list[int]]:
    """Given names with their titles' genders, family names, the places of the parts behind titles, lone initials."""
    givens: dict[str, set[str]] = {}
    families, titled, alone, lone = set(), {}, [], []
    for match in _TITLED.finditer(text):
        titles = _ONE_TITLE.findall(match["titles"])
        gender = next((g for g in map(_GENDER.get, titles) if g != "n"), "n")
        parts = [(m.start(), _name(_bare(m[0]))) for m in _CAPITAL.finditer(text, match.start("value"), match.end("value"))]
        # a capitalised particle before a part is no part
        parts = [p for i, p in enumerate(parts) if i + 1 == len(parts) or not re.fullmatch(_PARTICLE, text[p[0]:p[0] + len(p[1])])]
        titled.update((at, gender) for at, _ in parts)
        if not parts:
            lone.append(match.start("value"))
        elif len(parts) == 1 and not re.match(_INITIAL, match["value"]):
            alone.append((parts[0][1], gender))
        else:
            last = 2 if len(parts) > 2 and _TWO_FAMILIES.intersection(titles) else 1
            families.update(name for _, name in parts[-last:])
            for _, name in parts[:-last]:
                givens.setdefault(name, set()).add(gender)
    for name, gender in alone:
        if name in givens:
            givens[name].add(gender)
        else:
            families.add(name)
    return givens, families, titled, lone


def _initials(text: str, begin: int, end: int) -> list[tuple[int, int, str, str, str]]:
    """The initials right before ``end``, none of them before ``begin``; the last comes first."""
    out = []
    while (match := _LAST_INITIAL.search(text, max(begin, end - 16), end)) is not None:
        out.append((match.start(), match.start() + 1, "name", f"initial|{match[0][0].casefold()}", "n"))
        end = match.start()
    return out


def _names(text: str) -> list[tuple[int, int, str, str, str]]:
    """Given and family names that a title introduces, at all their mentions, with the given name's gender, and their initials."""
    givens, families, titled, lone = _titled_names(text)
    out: list[tuple[int, int, str, str, str]] = []
    for at in lone:
        out.append((at, at + 1, "name", f"initial|{text[at].casefold()}", "n"))
    if not titled:
        return out
    small = {_name(w) for w in _SMALL.findall(text)}
    words = []
    for match in _CAPITAL.finditer(text):
        word = _bare(match[0])
        name = _name(word)
        if name not in givens and name not in families:
            if len(name) < 4 or name[-1] != "s" or name in small or not (name[:-1] in givens or name[:-1] in families):
                continue
            word, name = word[:-1], name[:-1]
        words.append((match.start(), match.start() + len(word), name))
    before, part_of = 0, ""
    for i, (at, end, name) in enumerate(words):
        joined = bool(part_of) and _GAP.fullmatch(text, before, at) is not None
        after = i + 1 < len(words) and words[i + 1][2] in families and _GAP.fullmatch(text, end, words[i + 1][0]) is not None
        follows = joined and part_of == "given"
        role = "family" if name in families and (follows or name not in givens) else "given"
        # a word that the text also writes small is a name only beside a title or another part
        if at not in titled and not follows and not (role == "given" and after) and name in small:
            part_of = ""
            continue
        known = givens.get(name, set()) - {"n"}
        gender = next(iter(known)) if len(known) == 1 else titled.get(at, min(known, default="n"))
        if role == "family":
            out += _initials(text, before, at)
        elif at in titled or after:
            # initials before a given name: J. Robert Smith
            out += _initials(text, before, at)
        out.append((at, end, "name", f"{role}|{name}", gender))
        before, part_of = end, role
    return out


def _is_address(value: str) -> bool:
    """Whether it is a version 6 address; of short forms only those with three groups or more, as others may be program text."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return sum(map(bool, value.split(":"))) > 2


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, normal form), in order and without overlaps; the earliest, then the longest counts."""
    return [e[:4] for e in _found(text)]


def _found(text: str) -> list[tuple[int, int, str, str, str]]:
    """The same, and the gender of a given name."""
    found = _names(text) if _NEEDED["name"].search(text) else []
    holds = {k: p.search(text) is not None for k, p in _NEEDED.items() if k != "name"}
    for kind, pattern in PATTERNS:
        if not holds.get(kind, holds[""]):
            continue
        for match in pattern.finditer(text):
            part = "value" if "value" in pattern.groupindex else 0
            value = match[part]
            if kind == "secret" and part and not re.search(r"\d", value):
                continue
            if kind == "ip" and ":" in value and not _is_address(value):
                continue
            if kind == "card" and "c" in pattern.groupindex and not luhn(re.sub(r"\D", "", value)):
                continue
            found.append((match.start(part), match.end(part), kind, _normal(kind, value), ""))
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[tuple[int, int, str, str, str]] = []
    for entity in found:
        if not out or entity[0] >= out[-1][1]:
            out.append(entity)
    return out


def _bits(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permuted(key: bytes, label: str, digits: str) -> str:
    """A keyed permutation of the digit strings of one length: alternating rounds over its two halves."""
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    for i in range(8):
        if i % 2:
            b = str((int(b or 0) + _bits(key, label, i, a)) % 10 ** len(b)).zfill(len(b)) if b else b
        else:
            a = str((int(a or 0) + _bits(key, label, i, b)) % 10 ** len(a)).zfill(len(a)) if a else a
    return a + b


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + (i % 2)) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _walk(start: str, step, fits) -> str:
    """The first that fits on the way a permutation takes; again a permutation of those that fit."""
    value = step(start)
    while not fits(value):
        value = step(value)
    return value


def _word(key: bytes, syllables: list[str], count: int, *parts: object) -> str:
    number, out = _bits(key, *parts), ""
    for _ in range(count):
        number, at = divmod(number, len(syllables))
        out += syllables[at]
    return out


@lru_cache(maxsize=65536)
def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """The normal form of an entity's surrogate."""
    label = f"{kind}#{attempt}"
    if kind in ("card", "ssn"):
        right = luhn(normal)
        first = "0123456789" if len(normal) == 16 or kind == "ssn" else "23456"
        return _walk(normal, lambda d: permuted(key, label, d), lambda d: d[0] in first and (kind == "ssn" or luhn(d) == right))
    if kind == "phone":
        # the country code stays, as far as it can be told from the number's length
        if normal[0] == "+":
            head = normal[:4] if normal[1:3] in ("33", "34") and len(normal) == 12 else normal[:max(1, len(normal) - 10)]
        else:
            # so do a leading zero or one and what tells a plan of nine digits; after a zero comes none
            head = normal[0] if len(normal) == 9 or len(normal) > 7 and normal[0] == "0" or len(normal) == 11 else ""
        zero = len(head) == len(normal) or normal[len(head)] == "0"
        return head + _walk(normal[len(head):], lambda d: permuted(key, label + head, d), lambda d: not head or head[0] == "+" or zero or d[0] != "0")
    if kind == "ip" and ":" in normal:
        packed = str(int(ipaddress.IPv6Address(normal))).zfill(39)
        return str(ipaddress.IPv6Address(int(_walk(packed, lambda d: permuted(key, label, d), lambda d: int(d) < 1 << 128))))
    if kind == "ip":
        packed = sum(int(o) << 8 * (3 - i) for i, o in enumerate(normal.split(".")))
        number = int(_walk(str(packed).zfill(10), lambda d: permuted(key, label, d), lambda d: int(d) < 1 << 32))
        return ".".join(str(number >> 8 * (3 - i) & 255) for i in range(4))
    if kind == "email":
        local, domain = normal.rsplit("@", 1)
        letters = _SYLLABLES["LATIN"][0]
        digits = re.search(r"\d*$", local)[0]
        number = str(_bits(key, label, local, "digits") % 10 ** len(digits)).zfill(len(digits)) if digits else ""
        join = re.search(r"[._+-](?=\d*$)", local)
        words = local[:len(local) - len(digits)]
        if _NAME_ADDRESS.fullmatch(words):
            parts = re.split(r"([._-])", words)
            for i in range(0, len(parts), 2):
                role = "initial" if len(parts[i]) == 1 else "family" if i == len(parts) - 1 else "given"
                parts[i] = surrogate(key, "name", f"{role}|{parts[i]}", attempt).split("|", 1)[1].casefold()
            return "".join(parts) + number + "@" + _word(key, letters, 5, "domain", domain) + ".example." + domain.rsplit(".", 1)[1]
        return (_word(key, letters, 8, label, normal) + (join[0] if join else "") + number + "@"
                + _word(key, letters, 5, "domain", domain) + ".example." + domain.rsplit(".", 1)[1])
    if kind == "name":
        role, name = normal.split("|", 1)
        if role == "initial":
            alphabet = _ALPHABETS[script_of(name)]
            letter, marks = name.upper(), ""
            if letter not in alphabet:
                plain = unicodedata.normalize("NFD", letter)
                letter, marks = plain[0], plain[1:]
            # the next one in a keyed circle of the letters, so none stays
            circle = sorted(alphabet, key=lambda c: _bits(key, label, role, c))
            at = circle.index(letter) + 1 if letter in alphabet else _bits(key, label, role, name)
            return f"{role}|" + unicodedata.normalize("NFC", circle[at % len(circle)] + marks)
        syllables, _, last = _SYLLABLES[script_of(name)]
        # a given name gets its ending, by gender, where it is mentioned
        return f"{role}|" + (_word(key, syllables, 4, label, role, name) if role == "given" else _word(key, syllables, 6, label, role, name) + last)
    # secrets and account numbers: each character by one of its class, a known prefix stays
    head = _PREFIX.match(normal)
    kept = head.end() if head else 2 if kind == "iban" else 0
    low = "abcdef" if re.fullmatch(r"[0-9a-f]+", normal[kept:]) else "abcdefghijklmnopqrstuvwxyz"
    number, out = _bits(key, label, normal), normal[:kept]
    for i, c in enumerate(normal[kept:]):
        if i % 32 == 31:
            number = _bits(key, label, normal, i)
        letters = "0123456789" if c.isdigit() else low if c.islower() else low.upper() if c.isupper() else c
        number, at = divmod(number, len(letters))
        out += letters[at]
    return out


def _in_form(kind: str, mention: str, new: str, gender: str = "") -> str:
    """The surrogate in the mention's form."""
    if kind == "phone" and "(0)" in mention:
        before, after = mention.split("(0)", 1)
        at = 1 + sum(c.isdigit() for c in before)
        return _in_form(kind, before, new[:at]) + "(0)" + _in_form(kind, after, new[at:])
    if kind in ("phone", "card", "ssn", "iban"):
        letters = iter(new.lstrip("+"))
        return "".join(next(letters) if c.isalnum() else c for c in mention)
    if kind == "name":
        role, word = new.split("|", 1)
        word += _SYLLABLES[script_of(word)][1][gender] if role == "given" else ""
        return word.upper() if mention.isupper() and len(mention) > 1 else word.capitalize()
    return new.upper() if kind in ("email", "ip") and mention.isupper() else new


def replace_in(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced, in order."""
    out, at, kinds, named, joined = [], 0, [], -1, _JOINED
    for begin, end, kind, normal, gender in _found(text):
        new = surrogate(key, kind, normal, attempts.get((kind, normal), 0))
        out += [text[at:begin], _in_form(kind, text[begin:end], new, gender)]
        at = end
        if kind != "name" or named < 0 or not joined.fullmatch(text, named, begin):  # a whole name counts once
            kinds.append(kind)
        named = end if kind == "name" else -1
        joined = _INITIAL_JOINED if normal.startswith("initial|") else _JOINED
    return "".join([*out, text[at:]]), kinds


def _entities(batches) -> Iterator[pa.RecordBatch]:
    for batch in texts_in_blocks(batches, 0):
        found = {e[2:] for text in batch.column(0).to_pylist() if text for e in detect(text) if not e[3].startswith("initial|")}
        if found:
            kinds, normals = zip(*sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(normals)], ["kind", "normal"])


def _tried(batches, key) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        new = [surrogate(key, r["kind"], r["normal"], r["attempt"]) for r in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "normal", "attempt", "new"])


def exceptions(entities: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(kind, normal, attempt) of the entities whose first surrogate met another one or an entity.

    ``entities`` holds each (kind, normal) once; initials, of which all letters may be in use, are not among them. What still meets after
    ``rounds`` (a space that is all but full) is an error, not a silent clash.
    """
    tried = written(entities.withColumn("attempt", F.lit(0)).mapInArrow(
        partial(_tried, key=key), "kind string, normal string, attempt int, new string"))
    for _ in range(rounds):
        # of those that share a surrogate one keeps it, preferably one that had it before
        keeps = tried.groupBy("kind", "new").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "normal"))["normal"].alias("keeper"))
        real = entities.select("kind", F.col("normal").alias("new"))
        bare = F.regexp_replace("normal", "(?:n|a|l|н|а|ль|σ|α|ν)$", "")  # a given name without its ending
        real = real.union(entities.where("kind = 'name' and normal like 'given|%'").select("kind", bare)).distinct().withColumn("is_real", F.lit(True))
        clash = keeps.join(real, ["kind", "new"], "left").where("n > 1 or is_real")
        clash = clash.select("kind", "new", F.when(F.col("is_real"), F.lit(None)).otherwise(F.col("keeper")).alias("keeper"), F.lit(True).alias("clashes"))
        moved = tried.join(clash, ["kind", "new"], "left").withColumn(
            "again", F.col("clashes").isNotNull() & ~F.coalesce(F.col("keeper") == F.col("normal"), F.lit(False)))
        moved = written(moved.select("kind", "normal", "attempt", "new", "again"))
        if not moved.where("again").limit(1).count():
            return moved.where("attempt > 0").select("kind", "normal", "attempt")
        retry = moved.where("again").select("kind", "normal", (F.col("attempt") + 1).alias("attempt")).mapInArrow(
            partial(_tried, key=key), "kind string, normal string, attempt int, new string")
        tried = written(moved.where("not again").drop("again").union(retry))
    raise ValueError(f"surrogates still meet after {rounds} rounds")


def _replace(batches, text, key, attempts, own) -> Iterator[pa.RecordBatch]:
    """``own``: the exceptions of a row come as its last column instead."""
    shared = {} if own else attempts.value
    for batch in texts_in_blocks(batches, text):
        at = batch.schema.get_field_index(text)
        columns = list(batch.columns)
        extra = columns.pop() if own else None
        texts, kinds = [], []
        for row, value in enumerate(columns[at].to_pylist()):
            if own:
                shared = {(e["kind"], e["normal"]): e["attempt"] for e in extra[row].as_py() or ()}
            new, found = replace_in(value, key, shared) if value else (value, [])
            texts.append(new)
            kinds.append(found)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], [*batch.schema.names[:len(columns)], "replaced_kinds"])


def _mentions(batches) -> Iterator[pa.RecordBatch]:
    for batch in texts_in_blocks(batches, 1):
        rows = [(n, *e[2:]) for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for e in detect(text)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*sorted(set(rows)))], ["_row", "kind", "normal"])


def replace(df: DataFrame, key: bytes, text: str = "text", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with surrogates in ``text``, and ``replaced_kinds``: the kinds of its entities, in order."""
    spark = df.sparkSession
    df = df.drop("replaced_kinds")
    entities = written(df.select(F.col(text)).mapInArrow(_entities, "kind string, normal string").distinct())
    odd = exceptions(entities, key)
    schema = T.StructType([*df.schema.fields, T.StructField("replaced_kinds", T.ArrayType(T.StringType()))])
    if odd.count() <= broadcast_limit:
        rows = odd.toArrow().to_pylist()
        attempts = spark.sparkContext.broadcast({(r["kind"], r["normal"]): r["attempt"] for r in rows})
        return df.mapInArrow(partial(_replace, text=text, key=key, attempts=attempts, own=False), schema)
    numbered = written(df.withColumn("_row", F.monotonically_increasing_id()))
    mentions = numbered.select("_row", text).mapInArrow(_mentions, "_row long, kind string, normal string")
    by_row = mentions.join(odd, ["kind", "normal"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("_odd"))
    joined = numbered.join(by_row, "_row", "left").select(*df.columns, "_odd")
    return joined.mapInArrow(partial(_replace, text=text, key=key, attempts=None, own=True), schema)


@query("op2_pii_surrogates")
def op2_pii_surrogates(spark, sf_dir):
    """Every document with surrogates for its personal data and secrets."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a key of production comes from the job's settings; this one makes results repeatable
    return replace(documents, key=b"callscope-example-key").select(
        "doc_id", "text", F.size("replaced_kinds").cast("long").alias("n_replaced"), F.array_join("replaced_kinds", ",").alias("replaced_kinds"))

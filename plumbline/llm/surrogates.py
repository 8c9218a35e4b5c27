"""PII: detected entities get keyed surrogates of the same type and format.

Detected are e-mail addresses, IPv4 and IPv6 addresses, payment card numbers whose check digit holds, phone numbers (bare
digits only after a word such as phone), US social security numbers, IBANs whose check digits hold, access keys, assigned
tokens and passwords, and names after forms of address (one or several) or a label such as Name. A name has any number of
parts, initials and particles (von der, de la), between any blanks; after its title it may stand on the next line. A name's
parts, wherever else in its document they stand with a capital, are mentions of it, also with an ending of Russian or German
cases, which the surrogate keeps. Parts that are everyday words (COMMON) are mentions only next to another part or, if no
article stands before them, inside a sentence; a family name also where a sentence begins. Particles stay; an initial becomes another. Names without any title or label in
their document are not found.

An entity's canonical form (digits of a number, small letters of an address or a name's part) is mapped by a keyed
permutation of all forms of the same pattern, digits to digits and letters to letters; the surface gets it back
with the separators and capitals it had. Card numbers keep their length and network digit and a valid check digit; IBANs
their country and valid check digits; phone numbers the country code; IP addresses their class (private, loopback, public
and so on); e-mail addresses go to example domains. A name's part gets an invented name of the same script, with an
ending of its gender: that of the titles by which most documents address it, none if they are as many. It is one name
for one part, whatever the title, the capitals or the document. The key alone decides, so equal keys join equal
entities over runs; whoever holds it can undo the surrogates of numbers, so it is as secret as the text.

Checks over the distinct entities of the whole corpus: a surrogate that is its own original, that is
another original, or that two originals share is drawn anew until none is left, the smallest original keeping
it. What a document cannot know by itself (entities drawn anew, genders told otherwise elsewhere) reaches it through a
join on entities, then on texts, both without hot keys.

Defined results: null text stays null, with 0 entities; empty text stays empty; texts are handled whole, however long;
repeated rows are replaced alike, and equal entities alike everywhere; extra columns are kept, but for one named
n_entities, which the count replaces. Without a key (the argument or the setting spark.plumbline.pii.key) nothing is
done and an error raised. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

#: The key of the queries over the synthetic tables, unless the session has one. The operator has none of its own.
QUERY_KEY = "synthetic tables"
ROUNDS = 8
#: A round's hash covers half the bits of a text of up to LONG characters; longer ones are taken in pieces.
LONG, PIECE = 85, 64
#: Attempts after which a secret's surrogate may be longer than it, if its pattern has no free form left.
CROWDED = 20
# Forms of address by gender, syllables and endings of invented names by script.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "г-жа", "госпожа", "κυρία"]
OPEN = ["Dr", "Prof", "Professor", "Mx"]
#: Words between a name's parts that are none.
PARTICLES = ["von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "do", "du", "la", "las", "los", "le", "ten", "ter", "zu", "zum", "zur", "vom", "al", "el", "bin", "ibn", "bint", "af", "av", "y", "e", "i", "san", "st", "фон", "де", "ван", "дер"]
#: Names that are everyday words, and what stands before such a word where it is one.
COMMON = set("will mark may grace hope faith joy rose art bill drew grant chase pat rich jack frank april june august dawn summer autumn winter page king baker cook young long hall hill wood woods stone rivers field fields church bishop price rice bush bird fox wolf lane street law day sunday gates banks wells brown black white green gray grey best love short small little strong sharp moody power parks park bell ball carter mason miller smart wise good noble case chance miles max van guy penny ruby crystal amber ivy lily daisy iris violet olive heather holly sky star stern klein gross lang jung vogel fuchs stein berg baum brand kaiser richter".split())
ARTICLES = set("the a an this that these those each every no any some my your his its our their which what der die das den dem des ein eine einen einem einer le la les un une el los las una uno il lo gli".split())
LABELS = ["Name", "Full name", "Nombre", "Nom", "Имя", "Όνομα"]
PHONES = ["phone", "telephone", "tel", "mobile", "cell", "fax", "whatsapp"]
SYLLABLES = {
    "latin": ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"],
    "greek": ["βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "φο", "χυ", "ψα"],
}
ENDINGS = {
    "latin": {"m": ["n", "r", "s", "l"], "f": ["na", "la", "ra", "sa"], "": ["t", "m", "k", "nd"]},
    "cyrillic": {"m": ["н", "р", "с", "л"], "f": ["на", "ла", "ра", "са"], "": ["т", "м", "к", "в"]},
    "greek": {"m": ["νος", "ρος", "λος", "τος"], "f": ["να", "ρα", "λα", "τα"], "": ["νης", "ρης", "λης", "της"]},
}
# Classes of IP addresses other than public ones (first address, bits that are free in it).
CLASSES = [("0.0.0.0", 24), ("10.0.0.0", 24), ("100.64.0.0", 22), ("127.0.0.0", 24), ("169.254.0.0", 16), ("172.16.0.0", 20), ("192.168.0.0", 16), ("224.0.0.0", 28), ("240.0.0.0", 28)]
_CLASSES = [(int(ipaddress.IPv4Address(a)), 1 << bits) for a, bits in CLASSES]
_TITLES = "|".join(map(re.escape, sorted(MALE + FEMALE + OPEN, key=len, reverse=True)))
_LABELS, _PHONES = "|".join(LABELS), "|".join(PHONES)
_UPPER = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x370, 0x530)] if chr(c).isupper())
_BLANKS = r"[^\S\n]+"
_UNIT = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}){_BLANKS}){{0,3}}(?:[dD]['’])?(?:(?:[{_UPPER}]\.)+|[{_UPPER}][\w'’-]*\w(?![\w'’-]|[^\S\n]?:)|[{_UPPER}](?={_BLANKS}[{_UPPER}][\w'’-]))"
_NAME = rf"{_UNIT}(?:{_BLANKS}{_UNIT})*"
_PATTERNS = [
    ("email", r"(?<![\w.+-])[^\W_][\w.+%-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}"),
    ("access", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i:(?<![a-z])(?:token|secret|api[_-]?key|password|passwd|pwd)\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_+/.~-]{6,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?:?(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?![\w:])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.-])[3-6](?:[ -]?\d){12,18}(?![\w-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.])\+\d{1,3}(?:[ .-]?\d){7,12}(?![\w-])"),
    ("bare", rf"(?<![A-Za-z])(?i:{_PHONES})(?:\.|:| no\.?)?:? {{0,2}}(?P<number>\d{{7,12}})(?![\w-])"),
    ("name", rf"(?<!\w)(?:(?P<title>(?:{_TITLES})(?:\.?\s+(?:{_TITLES})(?!\w))*)\.?\s+|(?:{_LABELS}){_BLANKS.replace('+', '*')}:{_BLANKS.replace('+', '*')})(?P<name>{_NAME})"),
]
_ENTITY = re.compile("|".join(f"(?P<t_{t}>{p})" for t, p in _PATTERNS))
_GROUP = {"secret": "secret", "bare": "number"}
#: Texts without any of these hold no entity.
_HINT = re.compile(rf"[0-9@]|::|(?<!\w)(?:{_TITLES}|{_LABELS})(?!\w)|(?i:token|secret|key|passw|pwd)")
_WORD = re.compile(r"[^\W\d_][\w'’]*")
_OWN = re.compile(r"['’]s$", re.I)
#: A name's parts: what stands between blanks, hyphens, the stops of initials, and after an elided particle.
_PIECE = re.compile(r"(?:(?<![\w'’])[dD]['’])?([^\s.-]+)")


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), "big")


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to size - 1: a balanced Feistel network over the next even number of bits, walked back into range."""
    if size < 2:
        return x
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_number(key, tweak, size, r, right) & mask)
        x = left << half | right
        if x < size:
            return x


def _digest(key: bytes, *parts: str) -> str:
    return hashlib.blake2b("\0".join(parts).encode(), key=key, digest_size=32).hexdigest()


def reformed_long(text: str, key: bytes, tweak: str, hexadecimal: bool) -> str:
    """As reformed, in pieces that one permutation covers: forwards each piece depends on those before it, then backwards on those behind."""
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    for way in ("forwards", "backwards"):
        state = _digest(key, tweak, way, str(len(text)))
        for i, piece in enumerate(pieces):
            pieces[i] = reformed(piece, key, f"{tweak}:{state}", hexadecimal)
            state = _digest(key, state, pieces[i])
        pieces.reverse()
    return "".join(pieces)


def reformed(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Digits to digits and small or capital ASCII letters to their like, by one permutation of all texts of the same pattern."""
    if len(text) > LONG:
        return reformed_long(text, key, tweak, hexadecimal)
    sets = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            sets.append("0123456789abcdef")
        else:
            sets.append("0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c)
    x, size = 0, 1
    for c, own in zip(text, sets, strict=True):
        x, size = x * len(own) + own.index(c), size * len(own)
    x = permuted(x, size, key, f"{tweak}:{''.join(o[0] if len(o) > 1 else '=' + o for o in sets)}")
    out = []
    for own in reversed(sets):
        x, i = divmod(x, len(own))
        out.append(own[i])
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The sum modulo 10; 0 where the check digit holds."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def mod97(iban: str) -> int:
    """1 where the check digits hold."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def moved_ip(x: int, key: bytes, tweak: str) -> int:
    """An address of the same class."""
    for first, size in _CLASSES:
        if first <= x < first + size:
            return first + permuted(x - first, size, key, f"{tweak}:{first}")
    while True:  # a permutation of all, walked until it is a public one again
        x = permuted(x, 1 << 32, key, tweak)
        if not any(first <= x < first + size for first, size in _CLASSES):
            return x


def script(word: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", word) else "greek" if re.search("[Α-Ωα-ωά-ώ]", word) else "latin"


def gender(titles: str) -> str:
    """That of the first title that has one."""
    return next((sex for t in re.findall(_TITLES, titles) for sex, own in (("m", MALE), ("f", FEMALE)) if t in own), "")


# Endings of Russian cases by a name's last letters, how many letters they replace, and the ending of a German or English one.
CASES = [(("ий", "ый", "ой"), 2, ["ого", "ому", "им", "ым", "ом", "ая", "ую", "ой"]), (("й",), 1, ["я", "ю", "ем", "е"]), (("а",), 1, ["ы", "е", "у", "ой", "ою"]), (("я",), 1, ["и", "е", "ю", "ей"]), ((*"бвгджзклмнпрстфхцчшщ",), 0, ["а", "у", "ым", "ом", "е", "ой", "ы", "ых", "ам", "ами"])]
GENITIVE = "s"


def bent_forms(part: str) -> dict[str, tuple[int, str]]:
    """Other forms of a name's part: how many of its last letters they replace, and by what."""
    if script(part) == "cyrillic" and len(part) > 2:
        return {part[: len(part) - cut] + e: (cut, e) for ends, cut, endings in CASES if part.endswith(ends) for e in endings}
    return {part + GENITIVE: (0, GENITIVE)} if script(part) == "latin" and len(part) > 3 and not part.endswith(("s", "x", "z", "ß")) else {}


def canonical(kind: str, surface: str) -> str:
    if kind == "email":
        return surface.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", surface)
    if kind == "phone":
        digits = re.sub(r"\D", "", surface)
        return digits[-10:] if len(digits) == 10 or len(digits) == 11 and digits[0] == "1" else digits
    return surface.replace(" ", "") if kind == "iban" else surface


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0, sex: str = "") -> str:
    """The surrogate of a canonical form; names are in small letters."""
    tweak = f"{kind}:{attempt}"
    if kind == "email":
        local, _, domain = "".join(c if c.isascii() else "abcdefghijklmnopqrstuvwxyz"[ord(c) % 26] for c in canon).rpartition("@")
        host = ".".join(domain.split(".")[:-2]) if domain.endswith((".example.com", ".example.org", ".example.net")) else domain.rpartition(".")[0]
        moved = reformed(f"{local}@{host}", key, tweak) if host else reformed(local, key, tweak) + "@"
        tail = domain.rpartition(".")[2]
        return moved + ("." if host else "") + f"example.{tail if tail in ('com', 'org', 'net') else 'com'}"
    if kind == "ip":
        return str(ipaddress.IPv4Address(moved_ip(int(ipaddress.IPv4Address(canon)), key, tweak)))
    if kind == "ip6":  # the first 16 bits tell the class, groups of zeros stay
        groups = [canon[i : i + 4] for i in range(0, 32, 4)]
        live = [i for i in range(1, 8) if groups[i] != "0000"]
        moved = reformed("".join(groups[i] for i in live), key, f"{tweak}{groups[0]}{live}", hexadecimal=True)
        return "".join(moved[4 * live.index(i) :][:4] if i in live else g for i, g in enumerate(groups))
    if kind == "card":
        body = canon[0] + reformed(canon[1:-1], key, tweak + canon[0])
        off = luhn(canon)
        return next(body + d for d in "0123456789" if luhn(body + d) == off)
    if kind == "phone":
        keep = 1 if len(canon) == 10 else 3
        return canon[:keep] + reformed(canon[keep:], key, tweak + canon[:keep])
    if kind == "access":
        return canon[:4] + reformed(canon[4:], key, tweak)
    if kind == "iban":
        body = reformed(canon[4:], key, tweak + canon[:2])
        return f"{canon[:2]}{98 - mod97(canon[:2] + '00' + body):02d}{body}"
    if kind == "name":
        own = script(canon)
        x = _number(key, tweak, canon)
        word = ""
        for _ in range(3 + x % 2 + attempt):
            x, i = divmod(x, 16)
            word += SYLLABLES[own][i]
        return word + ENDINGS[own][sex][x % 4]
    if kind == "secret" and attempt >= CROWDED:  # hardly any form of this pattern is free: a longer one
        canon += "".join(str(_number(key, tweak, i, canon) % 10) for i in range(attempt - CROWDED + 4))
    return reformed(canon, key, tweak, hexadecimal=kind == "secret" and re.fullmatch(r"[0-9a-f]{16,}", canon) is not None)


def dressed(kind: str, surface: str, new: str) -> str:
    """A surrogate with the separators, spelling of the country code and capitals of the surface."""
    if kind == "email":
        return "".join(n.upper() if i < len(surface) and surface[i].isupper() else n for i, n in enumerate(new))
    if kind in ("card", "ssn", "phone", "iban"):
        out, left = [], list(new)
        for c in reversed(surface):  # from the end: a country code before it stays
            out.append(left.pop() if c.isalnum() and left else c)
        return "".join(reversed(out))
    if kind == "ip6":
        address = ipaddress.IPv6Address(int(new, 16))
        shown = address.exploded if len(surface) == 39 else str(address)
        return shown.upper() if surface.upper() == surface else shown
    if kind == "name":
        return new.upper() if len(surface) > 1 and surface.isupper() else new.capitalize()
    return new


def bent(surface: str, canon: str, new: str) -> str:
    """A name's surrogate in the form that the surface has: an initial, or with the ending of its case."""
    if len(canon) == 1:
        return new[0]
    if surface.casefold() == canon:
        return new
    cut, ending = bent_forms(canon)[surface.casefold()]
    return (new[:-cut] if cut and new[-1] in "аяийыо" else new) + ending


def _found(m: re.Match) -> tuple[int, int, str, str] | None:
    """(start, end, kind, canonical form) of a match that isn't a name, or None if it isn't what it looks like."""
    kind = m.lastgroup[2:] if m.lastgroup.startswith("t_") else next(t for t, _ in _PATTERNS if m.group(f"t_{t}") is not None)
    a, b = m.span(_GROUP[kind]) if kind in _GROUP else m.span()
    surface = m.string[a:b]
    if kind == "card" and luhn(re.sub(r"\D", "", surface)) or kind == "iban" and mod97(surface.replace(" ", "")) != 1:
        return None  # any long number, any code of letters and digits
    if kind == "ip6":
        surface = surface.rstrip(":") if not surface.endswith("::") else surface
        try:
            x = int(ipaddress.IPv6Address(surface))
        except ValueError:
            return None
        return (a, a + len(surface), kind, f"{x:032x}") if x > 1 and x & ((1 << 112) - 1) else None  # no, the own or a whole network's address
    if kind == "secret" and sum(c.isalnum() for c in surface) < 4:  # a rule of dashes or dots
        return None
    kind = "phone" if kind == "bare" else kind
    return a, b, kind, canonical(kind, surface)


def _mentions(text: str, taken: list[tuple[int, int, str, str]], parts: dict[str, str], family: set[str]) -> list[tuple[int, int, str, str]]:
    """Where known parts of names stand elsewhere. taken: entities in order; family: parts that have stood last in a name."""
    forms = {f: p for p in parts for f in bent_forms(p)} | {p: p for p in parts}
    out, unsure, at = [], [], 0
    for m in _WORD.finditer(text):
        a, word = m.start(), _OWN.sub("", m.group()).rstrip("'’")
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not word or not word[0].isupper() or (part := forms.get(word.casefold())) is None or at < len(taken) and taken[at][0] < m.end():
            continue
        (unsure if part in COMMON else out).append((a, a + len(word), "name", part))
    if unsure:
        names = [(x[0], x[1]) for x in (*taken, *out, *unsure) if x[2] == "name"]
        begins, ends = {a for a, _ in names}, {b for _, b in names}
        judged, seen = [], set()
        for x in unsure:
            before, after = text[max(0, x[0] - 80) : x[0]], text[x[1] : x[1] + 9]
            gap = len(after) - len(after.lstrip(" \t\xa0"))
            near = gap > 0 and x[1] + gap in begins or x[0] - (len(before) - len(before.rstrip(" \t\xa0"))) in ends and before[-1:].isspace()
            last = before.split()[-1:] or [""]
            article = last[0].casefold().strip("(,") in ARTICLES
            inside = bool(last[0]) and last[0][-1] not in ".!?…:;\"“”«»" and "\n" not in before[len(before.rstrip()) :]
            if inside and not article and not near:
                seen.add(x[3])
            judged.append((x, near or not article and (inside or x[3] in family), article))
        out += [x for x, sure, article in judged if sure or x[3] in seen and not article]
    return out


def entities(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, surface, canonical form, gender) of each entity in order; a name's parts are entities of their own."""
    found: list[tuple[int, int, str, str]] = []
    sexes: dict[str, str] = {}
    family: set[str] = set()
    if not _HINT.search(text):
        return []
    for m in _ENTITY.finditer(text):
        if m.group("name") is None:
            if one := _found(m):
                found.append(one)
            continue
        parts = []
        for p in _PIECE.finditer(text, *m.span("name")):
            word = _OWN.sub("", p.group(1)).rstrip("'’")
            if word[:1].isupper():
                parts.append((p.start(1), p.start(1) + len(word)))
        sex = gender(m.group("title") or "")
        for i, (a, b) in enumerate(parts):
            part = text[a:b].casefold()
            if b - a > 1:
                sexes[part] = sexes.get(part) or (sex if i < len(parts) - 1 else "")
                if i == len(parts) - 1:
                    family.add(part)
            found.append((a, b, "name", part))
    if sexes:  # other mentions of the same people
        found = sorted(found + _mentions(text, found, sexes, family))
    return [(a, b, kind, text[a:b], canon, sexes.get(canon, "") if kind == "name" else "") for a, b, kind, canon in found]


def replaced(text: str, key: bytes, told: dict[tuple[str, str], tuple[int, str]] | None = None, memo: dict | None = None) -> tuple[str, int]:
    """The text with surrogates, and how many. `told` has attempts and genders that the text itself doesn't show."""
    out, at, memo = [], 0, {} if memo is None else memo
    found = entities(text)
    for a, b, kind, surface, canon, sex in found:
        attempt, sex = (told or {}).get((kind, canon), (0, sex))
        new = memo.get((kind, canon, attempt, sex))
        if new is None:
            new = memo[kind, canon, attempt, sex] = surrogate(kind, canon, key, attempt, sex)
            if len(memo) > 100_000:
                memo.clear()
        out += [text[at:a], dressed(kind, surface, bent(surface, canon, new) if kind == "name" else new)]
        at = b
    return "".join(out) + text[at:], len(found)


def _detect(batches):
    """The distinct entities of each text."""
    for batch in batches:
        rows = [(k, *e) for k, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True) for e in sorted({e[2:3] + e[4:] for e in entities(text)})]
        k, kind, canon, sex = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array(c, pa.string()) for c in (kind, canon, sex))], ["text_key", "kind", "canon", "sex"])


def _draw(key: bytes):
    @common.tidy
    def run(batches):
        for batch in batches:
            new = [surrogate(*row[:2], key, *row[2:]) for row in zip(*(batch.column(x).to_pylist() for x in ("kind", "canon", "attempt", "sex")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, "new"])

    return run


def _rewrite(key: bytes, text_col: str, told_col: str, out: list[str]):
    @common.tidy
    def run(batches):
        memo: dict = {}
        for batch in batches:
            told = batch.column(told_col).to_pylist()
            done = [(None, 0) if t is None else replaced(t, key, {(r["kind"], r["canon"]): (r["attempt"], r["sex"]) for r in more or ()}, memo) for t, more in zip(batch.column(text_col).to_pylist(), told, strict=True)]
            new = {text_col: pa.array([t for t, _ in done], pa.string()), "n_entities": pa.array([n for _, n in done], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in out], out)

    return run


def entity_table(found: DataFrame, key: bytes) -> DataFrame:
    """A stored row per entity of found (kind, canon, sex; a row per text and entity): attempt, sex, rows, and `odd`, if texts can't tell these by themselves.

    No two entities of a kind have the same surrogate, and none has an original for its own.
    """
    votes = lambda s: F.count_if(F.col("sex") == s)
    sex = F.when(votes("m") > votes("f"), "m").when(votes("f") > votes("m"), "f").otherwise("")
    own = found.groupBy("kind", "canon").agg(sex.alias("sex"), F.min("sex").alias("a"), F.max("sex").alias("b"), F.count(F.lit(1)).alias("rows"))
    own = own.select("kind", "canon", "sex", "rows", ((F.col("a") != F.col("b")) | (F.col("sex") != F.col("a"))).alias("other"))
    drawn = "kind string, canon string, sex string, rows long, other boolean, attempt int, new string"
    table = common.stored(own.withColumn("attempt", F.lit(0)).mapInArrow(_draw(key), drawn), "drawn")
    originals = table.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real"))
    while True:
        shared = table.groupBy("kind", "new").agg(F.min("canon").alias("holder"), F.count(F.lit(1)).alias("m")).where("m > 1")
        bad = table.join(shared, ["kind", "new"], "left").join(originals, ["kind", "new"], "left")
        bad = common.stored(bad.where("real or (m > 1 and canon <> holder)").select("kind", "canon"), "collisions")
        if not bad.limit(1).count():
            return table.select("kind", "canon", "sex", "rows", "attempt", (F.col("other") | (F.col("attempt") > 0)).alias("odd"))
        again = table.join(bad, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("new").mapInArrow(_draw(key), drawn)
        table = common.stored(table.join(bad, ["kind", "canon"], "left_anti").unionByName(again), "drawn")


def told_texts(found: DataFrame, table: DataFrame) -> DataFrame:
    """text_key, told (attempt and gender of the entities that its text can't tell by itself), rows (texts of this key)."""
    odd = table.where("odd").select("kind", "canon", F.struct(F.col("attempt"), F.col("sex")).alias("own"), "rows")
    total = table.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    met = common.hot_split(found.select("text_key", "kind", "canon"), odd, ["kind", "canon"], ["own"], total).where("own is not null")
    one = F.struct("kind", "canon", F.col("own.attempt").alias("attempt"), F.col("own.sex").alias("sex"))
    whole = met.groupBy("text_key").agg(F.collect_set(one).alias("told"), F.count(F.lit(1)).alias("n"))  # a text's own entities
    return whole.select("text_key", "told", (F.col("n") / F.size("told")).cast("long").alias("rows"))


def replace_pii(df: DataFrame, *, text_col: str = "text", key: str | None = None) -> DataFrame:
    """df with surrogates in its text, and n_entities."""
    spark = df.sparkSession
    common.arrow_batches(spark)
    key = key or spark.conf.get("spark.plumbline.pii.key", None)
    if not key:
        raise ValueError("surrogates need a key: the argument or spark.plumbline.pii.key")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    mark = common.mark()
    text = F.col(text_col).cast("string")
    texts = df.where(text.isNotNull()).select(F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = common.stored(texts.mapInArrow(_detect, "text_key long, kind string, canon string, sex string"), "entities")
    told = common.stored(told_texts(found, entity_table(found, secret)), "told")
    rest = [c for c in df.columns if c not in (text_col, "n_entities")]
    key_col, told_col = common.private(df, "text_key", "told")
    keyed = df.select(*rest, text.alias(text_col), F.xxhash64(text).alias(key_col))
    is_told = bool(told.limit(1).count())
    if is_told:
        named = told.select(F.col("text_key").alias(key_col), F.col("told").alias(told_col), "rows")
        some = common.hot_split(keyed.where(F.col(text_col).isNotNull()), named, [key_col], [told_col], df.count())
        keyed = some.unionByName(keyed.where(F.col(text_col).isNull()), allowMissingColumns=True)
    else:
        keyed = keyed.withColumn(told_col, F.lit(None).cast(dict(told.dtypes)["told"]))
    common.drop_since(spark, mark, *([told] if is_told else []))
    out = [c for c in df.columns if c != "n_entities"] + ["n_entities"]
    kept = {f.name: f for f in df.schema.fields} | {text_col: StructField(text_col, StringType()), "n_entities": StructField("n_entities", LongType())}
    return keyed.drop(key_col).mapInArrow(_rewrite(secret, text_col, told_col, out), StructType([kept[c] for c in out]))


def query_key(spark: SparkSession) -> str:
    """The session's key, or that of the synthetic tables."""
    return spark.conf.get("spark.plumbline.pii.key", QUERY_KEY)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(common.table(spark, sf_dir, "documents").select("doc_id", "text"), key=query_key(spark))

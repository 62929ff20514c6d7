"""Format-preserving pseudonyms for personal data.

Numbers, dates, addresses and secrets are found in whole texts, validated, and permuted by a keyed Feistel
network over exactly the values of their format: a card number becomes another number of the same
length, layout and first digit with a right check digit, a date another date written the same way. The permutation
depends on the key and the format alone, so equal values get equal pseudonyms in every document and
nothing has to be remembered or joined. Whoever holds the key can invert it.

| kind | validated by | kept |
|---|---|---|
| email | local part, domain with a dot | separators, case, alphabet, last domain label |
| card | 13 to 19 digits, Luhn sum; the longest such from a digit group to the end of one | layout, first digit, Luhn sum |
| iban | country and length, remainder 97 | layout, country, character classes, remainder |
| ssn | area, group and serial in range | layout, ranges |
| ip | four octets, the first 1 to 223 | layout of four octets |
| phone | 10 to 15 digits after +, 10 as 3-3-4 with or without a leading 1, 10 to 12 with a leading 0 | layout, country code or leading 0 or 1, leading digits in range |
| date | calendar, 1900 to 2099 | layout: order, separator, digits of each part |
| key, secret | prefixed access key; a value named as password, token, secret or key | prefix, character classes |

Emails, keys and secrets are told apart by case: the same address in capitals is another value. A date has one
pseudonym in all layouts that can write it with two digits for day and month; shorter layouts have their own.
Not covered: phones without + that have no separator or other groupings, and phones written in letters.

Defined results: null stays null; a text without such values is unchanged, byte for byte; invalid look-alikes
stay; overlaps go to the kind first in ``KINDS``; the columns of the input stay, columns of the
names written here are replaced.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from earmark.llm.common import free_name, quoted, small_batches

ROUNDS = 10
# digits that one network permutes; longer values are chained part by part
MAX_DIGITS = 2048
DEMO_KEY = b"example key, replace in production"  # for the registered queries only; anyone can invert it
MAY_HOLD = re.compile(r"[0-9@=:]")
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX, HEX_ONLY = "0123456789abcdef", re.compile(r"[0-9a-f]+")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days

PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[\w+%-](?:[\w.+%-]*[\w+%-])?@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])"),
    "key": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    "secret": re.compile(
        r"(?i:(?<![a-z0-9])(?:pass(?:word|wd)|token|secret|api[_-]?key|(?:access|secret|private)[_-]key))"
        r"[\"']?\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9_\-/+.~]{8,})"
    ),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"),
    "date": re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-]|\.\d)"),
    "phone": re.compile(
        r"(?<![\w.+-])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}"
        # ten digits as 3-3-4, a leading 1 or not
        r"|(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}"
        # a leading 0: in pairs, or an area code and groups
        r"|0\d(?:[ .-]\d\d){4}"
        r"|(?:\(0\d{1,4}\) ?|0\d{1,4}[ /-])(?:\d{3,4}[ -]\d{4}|\d{5,8}|\d{2,4}(?:[ -]\d{2,4}){1,3}))(?![\w-])"
    ),
}
KINDS = tuple(PATTERNS)
GROUP = re.compile(r"\d+")
# digits of a whole number behind country codes where they are always as many
NATIONAL = {"1": 10, "7": 10, "33": 9, "34": 9, "44": 10, "48": 9, "52": 10, "90": 10, "91": 10, "351": 9, "375": 9, "380": 9, "420": 9}
WRITTEN_OUT = re.compile(r"\+\d{1,3}[ .-]?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)")


def _drawn(message: str, width: int, key: bytes) -> int:
    """A number of ``width`` keyed bytes; beyond one digest, in counter mode."""
    if width <= 64:
        return int.from_bytes(blake2b(message.encode(), key=key[:64], digest_size=width).digest())
    blocks = (blake2b(f"{j}|{message}".encode(), key=key[:64]).digest() for j in range(-(-width // 64)))
    return int.from_bytes(b"".join(blocks)[:width])


def permuted(n: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network on pairs, walked until in range."""
    if size < 2:
        return n
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (size.bit_length() + 7) // 8 + 8
    while True:
        left, right = divmod(n, b)
        for i in range(ROUNDS):
            half = right if i % 2 == 0 else left
            drawn = _drawn(f"{tweak}|{i}|{half}", width, key)
            if i % 2 == 0:
                left = (left + drawn) % a
            else:
                right = (right + drawn) % b
        n = left * b + right
        if n < size:
            return n


def _digits(values: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """Permute a value given digit by digit in mixed radices."""
    if len(values) > MAX_DIGITS:
        return _chained(values, radices, key, tweak)
    n, size = 0, 1
    for v, r in zip(values, radices):
        n, size = n * r + v, size * r
    n = permuted(n, size, key, tweak)
    out = []
    for r in reversed(radices):
        n, v = divmod(n, r)
        out.append(v)
    return out[::-1]


def _chained(values: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """Permute a long value part by part, forth and back, each part under a digest of those done before it."""
    out = list(values)
    tweak = blake2b(tweak.encode(), key=key[:64]).hexdigest()
    starts = range(0, len(out), MAX_DIGITS)
    for way, order in (("forth", starts), ("back", starts[::-1])):
        seen = ""
        for at in order:
            part = slice(at, at + MAX_DIGITS)
            out[part] = _digits(out[part], radices[part], key, f"{tweak}|{way}|{at}|{seen}")
            seen = blake2b(f"{seen}|{out[part]}".encode(), key=key[:64]).hexdigest()
    return out


def _relaid(text: str, new: str, of=str.isdigit) -> str:
    """The characters of ``text`` that satisfy ``of`` replaced in order by those of ``new``."""
    it = iter(new)
    return "".join(next(it) if of(c) else c for c in text)


@functools.cache
def _wide() -> dict[str, tuple[str, str]]:
    """(name, members) of the class of every letter and digit beyond ASCII: one category of one script in a block of code points.

    Blocks are 128 code points, 4096 from the ideographs on; what would be nearly alone in one goes into
    one class per category. Classes do not overlap, so permuting inside them can be inverted.
    """
    classes: dict[str, list[str]] = {}
    for c in filter(str.isalnum, map(chr, range(128, sys.maxunicode + 1))):
        block = ord(c) >> 7 if ord(c) < 0x2E80 else 0x1000 + (ord(c) >> 12)
        script = unicodedata.name(c, "").split(" ")[0]
        classes.setdefault(f"<{unicodedata.category(c)}{script}{block:x}>", []).append(c)
    for name in [n for n, members in classes.items() if len(members) < 8]:
        classes.setdefault(f"{name[:3]}>", []).extend(classes.pop(name))
    named = [(name, "".join(members)) for name, members in classes.items()]
    return {c: (name, members) for name, members in named for c in members}


def _class(c: str) -> tuple[str, str]:
    """(name, members) of a character's class; a character that stays is its own name, without members."""
    for name, members in (("a", LOWER), ("A", UPPER), ("9", DIGIT)):
        if c in members:
            return name, members
    return (c, "") if c < "\x80" else _wide().get(c, (c, ""))


def _classes(text: str, key: bytes, tweak: str) -> str:
    """Permute letters and digits within their classes; other characters stay."""
    names, sets = zip(*map(_class, text))
    places = [i for i, s in enumerate(sets) if s]
    form = "".join(names)
    new = _digits([sets[i].index(text[i]) for i in places], [len(sets[i]) for i in places], key, f"{tweak}|{form}")
    out = list(text)
    for i, v in zip(places, new):
        out[i] = sets[i][v]
    return "".join(out)


def _lettered(text: str, letters: str, key: bytes, tweak: str) -> str:
    """Permute a text over one alphabet."""
    new = _digits([letters.index(c) for c in text], [len(letters)] * len(text), key, f"{tweak}|{len(text)}")
    return "".join(letters[v] for v in new)


def luhn_digit(body: str) -> str:
    """The check digit that follows ``body``."""
    doubled = [int(c) * (2 - i % 2) for i, c in enumerate(reversed(body))]
    return str(-sum(d - 9 * (d > 9) for d in doubled) % 10)


def _card(text: str, key: bytes) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if luhn_digit(digits[:-1]) != digits[-1] or not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return None
    body = _digits([int(c) for c in digits[1:-1]], [10] * (len(digits) - 2), key, f"card|{digits[0]}|{len(digits)}")
    new = digits[0] + "".join(map(str, body))
    return _relaid(text, new + luhn_digit(new))


def _iban(text: str, key: bytes) -> str | None:
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    account = _classes(flat[4:], key, f"iban|{flat[:2]}")
    check = 98 - number(account + flat[:2] + "00") % 97
    return _relaid(text, f"{flat[:2]}{check:02d}{account}", str.isalnum)


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    new = _digits([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
    area = new[0] + 1 + (new[0] + 1 >= 666)
    return f"{area:03d}-{new[1] + 1:02d}-{new[2] + 1:04d}"


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if not 1 <= octets[0] <= 223 or max(octets) > 255 or any(x != str(int(x)) for x in text.split(".")):
        return None
    new = _digits([octets[0] - 1, *octets[1:]], [223, 256, 256, 256], key, "ip")
    return ".".join(map(str, [new[0] + 1, *new[1:]]))


def _phone(text: str, key: bytes) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    code = ""
    if text.startswith("+"):
        lead = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        code = lead[1] if lead else digits[:1]
    elif digits[0] == "0" or (digits[0] == "1" and len(digits) == 11):
        code = digits[0]
    rest = digits[len(code) :]
    most = 12 if code == "0" else 15
    if not 10 <= len(digits) <= most or len(rest) < 6:
        return None
    low = [2 if len(rest) == 10 and code in ("", "1") and i in (0, 3) and c >= "2" else 0 for i, c in enumerate(rest)]
    form = f"phone|{code or 1}|{len(rest)}|{''.join(map(str, low))}"
    new = _digits([int(c) - s for c, s in zip(rest, low)], [10 - s for s in low], key, form)
    return _relaid(text, code + "".join(str(v + s) for v, s in zip(new, low)))


def _date(text: str, key: bytes) -> str | None:
    """One permutation of all days, walked until the new day can be written in the given layout: a part of one
    digit stays one digit, and with slashes a day-first date stays one that cannot be read month first."""
    written = re.split(r"\D", text)
    parts, widths = [int(x) for x in written], [len(x) for x in written]
    separators = re.findall(r"\D", text)
    if len(set(separators)) != 1:
        return None
    iso = widths[0] == 4
    month_first = not iso and separators[0] == "/" and parts[1] <= 31 and parts[0] <= 12
    slots = (0, 1, 2) if iso else (2, 0, 1) if month_first else (2, 1, 0)  # where year, month and day stand
    try:
        days = (datetime.date(*(parts[i] for i in slots)) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= days < DAYS:
        return None
    least_day = 13 if separators[0] == "/" and not iso and not month_first else 1
    bare = 1 in widths  # beside a part of one digit, two digits have a leading 0 as they had before

    def fits(value: int, i: int) -> bool:
        return len(str(value)) <= widths[i] and (not bare or (value < 10) == (parts[i] < 10))

    while True:
        days = permuted(days, DAYS, key, "date")
        new = FIRST_DAY + datetime.timedelta(days)
        if new.day >= least_day and all(fits(v, i) for v, i in zip((new.month, new.day), slots[1:])):
            break
    out = [""] * 3
    for value, i in zip((new.year, new.month, new.day), slots):
        out[i] = str(value).zfill(widths[i])
    return separators[0].join(out)


def _email(text: str, key: bytes) -> str:
    local, domain = text.rsplit("@", 1)
    name, last = domain.rsplit(".", 1)
    return f"{_classes(local, key, 'local')}@{_classes(name, key, 'domain')}.{last}"


MAKE = {
    "email": _email,
    "key": lambda t, key: t[:4] + _lettered(t[4:], UPPER + DIGIT, key, "key"),
    "secret": lambda t, key: _lettered(t, HEX, key, "hex") if HEX_ONLY.fullmatch(t) else _classes(t, key, "secret"),
    "iban": _iban, "ssn": _ssn, "ip": _ip, "date": _date,
}


def _cards(text: str, start: int, end: int, key: bytes) -> Iterator[tuple[int, int, str]]:
    """The cards of a run of digit groups: at each group the longest valid one, then on behind it."""
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        ends, digits = [], 0
        for j in range(i, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits >= 13:
                ends.append(j)
        for j in reversed(ends):
            new = _card(text[groups[i][0] : groups[j][1]], key)
            if new is not None:
                yield groups[i][0], groups[j][1], new
                i = j
                break
        i += 1


def _phone_ends(text: str, start: int, end: int) -> list[int]:
    """Where a phone may end: at a complete national form, else as far as it goes, else a group earlier and so on."""
    ends = [m.end() for m in GROUP.finditer(text, start, end)]
    ends = [e + (text[e : e + 1] == ")" and e < end) for e in ends]
    first = WRITTEN_OUT.match(text, start, end)
    whole = [first.end()] if first else []
    if text[start] == "+":
        lead = re.compile(r"\+(\d{1,3})(?=[ .(-])").match(text, start, end)
        code = lead[1] if lead else ""
        whole += [e for e in ends if code in NATIONAL and sum(map(str.isdigit, text[start:e])) == len(code) + NATIONAL[code]]
    return [*whole, *reversed(ends)]


def _phones(text: str, pattern: re.Pattern, key: bytes) -> Iterator[tuple[int, int, str]]:
    """The phones of a text; after a failed start the search goes on behind its first character."""
    at = 0
    while m := pattern.search(text, at):
        at = m.start() + 1
        for end in _phone_ends(text, *m.span()):
            new = _phone(text[m.start() : end], key)
            if new is not None:
                yield m.start(), end, new
                at = end
                break


def values(text: str, kind: str, key: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the values of one kind."""
    pattern = PATTERNS[kind]
    if kind == "phone":
        yield from _phones(text, pattern, key)
        return
    for m in pattern.finditer(text):
        if kind == "card":
            yield from _cards(text, *m.span(), key)
            continue
        group = "value" if kind == "secret" else 0
        new = MAKE[kind](m[group], key)
        if new is not None:
            yield *m.span(group), new


def found(text: str, key: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values of a text, in order, without overlaps."""
    taken: list[tuple[int, int, str, str]] = []
    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        taken += [(start, end, kind, new) for start, end, new in values(text, kind, key)]
    starts: list[int] = []
    kept: list[tuple[int, int, str, str]] = []
    for value in taken:  # by kind, then by place
        i = bisect.bisect_left(starts, value[0])
        if (i and kept[i - 1][1] > value[0]) or (i < len(kept) and starts[i] < value[1]):
            continue
        starts.insert(i, value[0])
        kept.insert(i, value)
    yield from kept


def pseudonymised(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """A text with pseudonyms, and how many values of each kind it had."""
    if not MAY_HOLD.search(text):
        return text, {}
    parts, counts, at = [], {}, 0
    for start, end, kind, new in found(text, key):
        parts += [text[at:start], new]
        counts[kind] = counts.get(kind, 0) + 1
        at = end
    return ("".join([*parts, text[at:]]), counts) if parts else (text, {})


def replaced(docs: DataFrame, text: Column, key: bytes = DEMO_KEY) -> Column:
    """A struct (text, kinds, n_replaced) for a text column; kinds as ``card:1,email:2``."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<text: string, kinds: string, n_replaced: int>")
    def replace(texts: pa.Array) -> pa.Array:
        new, kinds, n = [], [], []
        for t in texts.to_pylist():
            out, counts = (None, {}) if t is None else pseudonymised(t, key)
            new.append(out)
            kinds.append(",".join(f"{k}:{c}" for k, c in sorted(counts.items())))
            n.append(sum(counts.values()))
        return pa.StructArray.from_arrays(
            [pa.array(new, type=pa.string()), pa.array(kinds, type=pa.string()), pa.array(n, type=pa.int32())],
            ["text", "kinds", "n_replaced"],
        )

    return replace(text)


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """The table with its texts pseudonymised, and the columns ``kinds`` and ``n_replaced``."""
    new = free_name(docs.columns, "_new")
    out = docs.withColumn(new, replaced(docs, *quoted([text_col]), key))
    kept = [c for c in docs.columns if c not in ("kinds", "n_replaced")]
    columns = [F.col(f"{new}.text").alias(c) if c == text_col else col for c, col in zip(kept, quoted(kept))]
    return out.select(*columns, F.col(f"{new}.kinds").alias("kinds"), F.col(f"{new}.n_replaced").alias("n_replaced"))

"""Format-preserving Feistel pseudonyms of validated numbers, dates and addresses.

A value that passes its format's check is a number within that format's domain; a keyed Feistel network permutes the
domain (walking on until a result is inside it), and the result is written in the value's own layout with new check
digits. Equal values have equal pseudonyms in all documents, and the key's holder can turn them back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DEFAULT_KEY = b"rastrel development key"

# Formats in the order in which they are tried, each with its pattern.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:(?:-| (?!\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}[/-]\d{1,2}[/-]\d|\d{3}-\d{2}-\d{4}(?!\d)|\d{1,3}(?:\.\d{1,3}){3}|[\w.+-]{1,64}@))?\d){12,}(?![\d-])",
    "phone": r"(?<![\w+])\+(?:1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,10})(?!\d)|(?<![\w+-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[.-]\d{4}(?![\d-])",
}
KINDS = tuple(PATTERNS)
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), re.ASCII)
_MAYBE = re.compile(r"[0-9@]")
# Letters and digits of an IBAN by country.
_IBAN_SIZE = {
    size: names.split()
    for size, names in {
        15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BJ DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
_IBAN_SIZE = {name: size for size, names in _IBAN_SIZE.items() for name in names}
# Country codes of one and of two digits; the others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NATIONAL = re.compile(r"[2-9]\d\d[2-9]\d{6}")
#: Digits of a card, in the order in which they are tried.
_CARD_SIZES = (16, 15, 14, 13, 19, 18, 17)
_GROUP = re.compile(r"\d+")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of range(n), one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: str, step: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{step}|{half}".encode(), key=self.key, digest_size=16).digest(), "big")

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        side = isqrt(n - 1) + 1 if n > 1 else 1
        tweak = f"{tweak}|{n}"
        while True:
            a, b = divmod(x, side)
            for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = (b - self._f(tweak, step, a)) % side, a
                else:
                    a, b = b, (a + self._f(tweak, step, b)) % side
            x = a * side + b
            if x < n:
                return x


def luhn_digit(digits: str) -> int:
    """The digit that completes digits to a number that passes the Luhn check."""
    total = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _filled(layout: str, fresh: str) -> str:
    """layout with its letters and digits replaced, in order, by those of fresh."""
    new = iter(fresh)
    return "".join(next(new) if c.isalnum() else c for c in layout)


def _mixed(f: Feistel, text: str, tweak: str, back: bool) -> str:
    """ASCII letters and digits permuted together, each to one of its class."""
    sizes = [10 if c.isdigit() else 26 for c in text]
    zero = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in text]
    x, n = 0, 1
    for c, z, s in zip(text, zero, sizes):
        x, n = x * s + ord(c) - ord(z), n * s
    x = f.permute(x, n, f"{tweak}|{''.join(zero)}", back)
    out = []
    for z, s in zip(reversed(zero), reversed(sizes)):
        x, r = divmod(x, s)
        out.append(chr(ord(z) + r))
    return "".join(reversed(out))


def _email(f: Feistel, v: str, back: bool) -> str | None:
    """Names that differ in case have pseudonyms that do so in the same places."""
    name, host = v.rsplit("@", 1)
    bare = re.sub(r"[^A-Za-z0-9]", "", name)
    new = _mixed(f, bare.lower(), "email", back)
    return _filled(name, "".join(c.upper() if own.isupper() else c for c, own in zip(new, bare))) + "@" + host


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(f: Feistel, v: str, back: bool) -> str | None:
    """What follows the country's length, if that ends at a blank, is no part of it and stays."""
    size = _IBAN_SIZE.get(v[:2], 0)
    at = next((k for k in range(len(v)) if v[k] == " " and k - v[:k].count(" ") == size), len(v))
    v, tail = v[:at], v[at:]
    bare = v.replace(" ", "")
    if not 15 <= len(bare) <= 34 or int(bare[2:4]) != _iban_check(bare[:2], bare[4:]):
        return None
    rest = _mixed(f, bare[4:], f"iban|{bare[:2]}", back)
    return _filled(v, f"{bare[:2]}{_iban_check(bare[:2], rest):02d}{rest}") + tail


def _date(f: Feistel, v: str, back: bool) -> str | None:
    """With the year last, a dot or hyphen means day first; with slashes, the month comes first wherever it can.

    A date with a part of one digit gets a pseudonym without leading zeros.
    """
    sep = next(c for c in v if not c.isdigit())
    parts = v.split(sep)
    if len(parts) != 3:
        return None
    pad = 2 if min(map(len, parts)) > 1 else 1
    order = "ymd" if len(parts[0]) == 4 else "mdy" if sep == "/" else "dmy"
    found = dict(zip(order, map(int, parts)))
    if order == "mdy" and found["m"] > 12:
        order, found = "dmy/", {"d": int(parts[0]), "m": int(parts[1]), "y": int(parts[2])}
    try:
        at = datetime.date(found["y"], found["m"], found["d"]).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= at <= _LAST_DAY:
        return None
    # a day past the 12th goes to another such day, in every layout, as a slash before the month can only stand there
    day, new = datetime.date.fromordinal(at), None
    while new is None or (new.day > 12) != (day.day > 12):
        at = _FIRST_DAY + f.permute(at - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date", back)
        new = datetime.date.fromordinal(at)
    text = {"y": f"{new.year:04d}", "m": f"{new.month:0{pad}d}", "d": f"{new.day:0{pad}d}"}
    return sep.join(text[c] for c in order.rstrip("/"))


def _ip(f: Feistel, v: str, back: bool) -> str | None:
    parts = [int(p) for p in v.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in v.split(".")):
        return None
    x = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(f: Feistel, v: str, back: bool) -> str | None:
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.permute(x, 898 * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _card_spots(v: str) -> list[tuple[int, int]]:
    """The places of cards in groups of digits: whole groups that pass the check, by size as in _CARD_SIZES, then from the left."""
    groups = [m.span() for m in _GROUP.finditer(v)]
    found: dict[int, list[tuple[int, int]]] = {}
    for i, (start, _) in enumerate(groups):
        size = 0
        for a, end in groups[i:]:
            size += end - a
            if size > 19:
                break
            if size >= 13:
                digits = re.sub(r"\D", "", v[start:end])
                if len(set(digits)) > 1 and luhn_digit(digits[:-1]) == int(digits[-1]):
                    found.setdefault(size, []).append((start, end))
    spots: list[tuple[int, int]] = []
    for a, b in (spot for size in _CARD_SIZES for spot in found.get(size, ())):
        if all(b <= c or d <= a for c, d in spots):
            spots.append((a, b))
    return sorted(spots)


def _card(f: Feistel, v: str, back: bool) -> str | None:
    """All cards of v replaced. The network is walked on while other places would pass for cards afterwards, so that the
    key's holder finds the same ones."""
    spots = _card_spots(v)
    if not spots:
        return None
    while True:
        for a, b in spots:
            v = v[:a] + _one_card(f, v[a:b], back) + v[b:]
        if _card_spots(v) == spots:
            return v


def _one_card(f: Feistel, v: str, back: bool) -> str:
    digits = re.sub(r"\D", "", v)
    n = len(digits) - 2  # the first digit, which names the network, stays
    body = digits[0] + f"{f.permute(int(digits[1:-1]), 10**n, f'card|{digits[0]}', back):0{n}d}"
    return _filled(v, body + str(luhn_digit(body)))


def _phone(f: Feistel, v: str, back: bool) -> str | None:
    """The digits after the country code, whatever stands between them; without a code a number of ten digits is one of
    +1. With +1, numbers that could stand without it are permuted among themselves."""
    digits = re.sub(r"\D", "", v)
    code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3]) if v[0] == "+" else "1"
    rest = digits[len(code) :] if v[0] == "+" else digits
    if not 7 <= len(rest) <= 12:
        return None
    new = rest
    while True:
        new = f"{f.permute(int(new), 10 ** len(rest), f'phone|+{code}', back):0{len(rest)}d}"
        if code != "1" or bool(_NATIONAL.fullmatch(new)) == bool(_NATIONAL.fullmatch(rest)):
            return _filled(v, code + new if v[0] == "+" else new)


_FORMATS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def replace(text: str, feistel: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """(text with each validated value replaced, values by kind). What fails its check stays as it is."""
    if not _MAYBE.search(text):
        return text, {}
    counts: dict[str, int] = {}

    def fresh(m: re.Match) -> str:
        new = _FORMATS[m.lastgroup](feistel, m[0], back)
        if new is None:
            return m[0]
        counts[m.lastgroup] = counts.get(m.lastgroup, 0) + (len(_card_spots(m[0])) if m.lastgroup == "card" else 1)
        return new

    return _ANY.sub(fresh, text), counts


def pseudonymised(docs: DataFrame, keep: list[str], key: bytes = DEFAULT_KEY, text: str = "text", back: bool = False) -> DataFrame:
    """The columns `keep`, `text` with pseudonyms, and n_<kind> and n_pii for each row; back undoes it.

    A null text stays null, with counts of zero; repeated rows stay; an empty table gives no rows. Digits are ASCII ones.
    """
    schema = docs.select(*keep).schema.add("text", "string")
    for kind in (*KINDS, "pii"):
        schema = schema.add(f"n_{kind}", "integer")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            found = [(None, {}) if t is None else replace(t, feistel, back) for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = [pa.array([c.get(k, 0) for _, c in found], pa.int32()) for k in KINDS]
            total = pa.array([sum(c.values()) for _, c in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in found], pa.string()), *counts, total], names)

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)

"""Personal data: format-preserving pseudonyms by keyed Feistel permutations."""

from __future__ import annotations

import hashlib
import re
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+(?=@[\w-]{1,63}(?:\.[\w-]{1,63})+)")
NUMBER = re.compile(
    r"(?P<phone>(?:(?<![\w+])\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w.-])\d{3}([.-])\d{3}\2\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w-])|(?<![\w.-])\d{4}-\d{2}-\d{2}(?=T\d{2}:\d{2}))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<card>(?<!\w)(?:\d{4}([ -])\d{4}\7\d{4}\7\d{1,7}|\d{4}([ -])\d{6}\8\d{5}|\d{13,19})(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w))"
)
KINDS = ["email", "phone", "ssn", "date", "ip", "card", "iban"]


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)``: Feistel rounds on the next even number of bits, walked until inside."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for k in range(ROUNDS):
            mixed = hashlib.blake2b(f"{tweak}|{size}|{k}|{right}".encode(), key=key, digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _digits(digits: str, key: bytes, tweak: str) -> str:
    return str(permuted(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits))


def _filled(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Sum that is divisible by ten for a valid number."""
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits) % 10:
        return None
    body = _digits(digits[:-1], key, "card")
    return _filled(text, body + str(-luhn(body + "0") % 10))


def phone(text: str, key: bytes) -> str:
    head, tail = re.fullmatch(r"(\+\d{1,3}(?=\D))?(.*)", text).groups()
    return (head or "") + _filled(tail, _digits(re.sub(r"\D", "", tail), key, "phone"))


def ssn(text: str, key: bytes) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = text.replace("-", "")
    if not valid(digits):
        return None
    while not valid(digits := _digits(digits, key, "ssn")):  # walks along the permutation back to a valid number
        pass
    return _filled(text, digits)


def day(text: str, key: bytes) -> str | None:
    """One permutation of the calendar's days serves all formats, so equal days stay equal: ``y-m-d``, ``d.m.y``, ``m/d/y``.

    ``d/m/y`` is taken only where the second number cannot be a day of the first one's month, and moves among such dates.
    A date with a field of one digit is written without leading zeros again, any other with them.
    """
    parts = [int(x) for x in re.split(r"\D", text)]
    for order in [(0, 1, 2)] if "-" in text else [(2, 1, 0)] if "." in text else [(2, 0, 1), (2, 1, 0)]:
        try:
            at = date(*(parts[i] for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        only = "/" in text and order == (2, 1, 0)
        while True:
            at = FIRST_DAY + permuted(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")
            new = date.fromordinal(at)
            if not only or new.day > 12:  # walks along the permutation back to a date that reads in this order alone
                break
        fields = dict(zip(order, (new.year, new.month, new.day)))
        wide = 2 if all(len(x) > 1 for x in re.split(r"\D", text)) else 1
        seps = [c for c in text if not c.isdigit()]
        out = [str(fields[i]).zfill(wide) for i in range(3)]
        return out[0] + seps[0] + out[1] + seps[1] + out[2]
    return None


def ip(text: str, key: bytes) -> str | None:
    """Each octet keeps its number of digits."""
    ranges = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
    parts = text.split(".")
    spans = [ranges[len(p)] for p in parts]
    if not all(lo <= int(p) < hi for p, (lo, hi) in zip(parts, spans)):
        return None
    at, size = 0, 1
    for p, (lo, hi) in zip(parts, spans):
        at, size = at * (hi - lo) + int(p) - lo, size * (hi - lo)
    at, out = permuted(at, size, key, "ip" + "".join(str(len(p)) for p in parts)), []
    for lo, hi in reversed(spans):
        at, k = divmod(at, hi - lo)
        out.append(str(lo + k))
    return ".".join(reversed(out))


def iban(text: str, key: bytes) -> str | None:
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(text[4:] + text[:4]) % 97 != 1:
        return None
    body = _mapped(text[4:], key, "iban")
    return text[:2] + str(98 - number(body + text[:2] + "00") % 97).zfill(2) + body


def _mapped(text: str, key: bytes, tweak: str) -> str:
    """Permute a string among those with the same classes of characters at the same places; other characters stay."""
    kinds = [("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else (c, 1) for c in text]
    at, size = 0, 1
    for c, (base, n) in zip(text, kinds):
        at, size = at * n + (ord(c) - ord(base) if n > 1 else 0), size * n
    if size == 1:
        return text
    at, out = permuted(at, size, key, tweak + "".join(b for b, _ in kinds)), []
    for base, n in reversed(kinds):
        at, k = divmod(at, n)
        out.append(chr(ord(base) + k))
    return "".join(reversed(out))


def local_part(text: str, key: bytes) -> str:
    return _mapped(text, key, "email")


def pseudonymised(text: str | None, key: bytes) -> tuple[str | None, list[int]]:
    """The text with all validated values replaced, and how many of each of ``KINDS``. Null stays null."""
    found = dict.fromkeys(KINDS, 0)
    if not text:
        return text, list(found.values())
    rules = {"phone": phone, "ssn": ssn, "date": day, "ip": ip, "card": card, "iban": iban}

    def number(m: re.Match) -> str:
        new = rules[m.lastgroup](m[0], key)
        found[m.lastgroup] += new is not None
        return m[0] if new is None else new

    def mail(m: re.Match) -> str:
        found["email"] += 1
        return local_part(m[0], key)

    text = NUMBER.sub(number, text)
    if "@" in text:
        text = EMAIL.sub(mail, text)
    return text, list(found.values())


def private(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_<kind>...): validated phone, social security and card numbers, dates, network and bank
    addresses and the local parts of e-mail addresses become keyed pseudonyms of the same format.

    Equal values get equal pseudonyms in every document, and one key always gives the same ones; different values stay
    different. Days are equal across formats (see ``day`` for slashes). Not covered: IPv6, year/month/day with slashes, bank
    addresses printed in groups, and phone numbers grouped otherwise than 3-3-4 or written without separators. Numbers that fail their check (Luhn sum, calendar, mod 97, octet range) are left as they are. Null texts
    stay null. Rows come back as often as given; other columns play no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for pdf in batches:
            done = [pseudonymised(t, key) for t in pdf["text"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "text": pd.Series([d[0] for d in done], index=pdf.index, dtype=object)})
            for k, name in enumerate(KINDS):
                out[f"n_{name}"] = [d[1][k] for d in done]
            yield out

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))

"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass their own check (card, IBAN, social security number,
IP address, calendar date, phone, e-mail address, named secret) are replaced by a
keyed permutation of all values of the same format: check digits are computed
anew, dates stay dates, letters stay letters. The permutation is a balanced
Feistel network with cycle walking, so it is one to one; with one key, equal
values get equal pseudonyms in every document, however they are punctuated.
"""

from __future__ import annotations

import datetime as dt
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_or_empty

ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "ip", "date", "phone", "secret")
#: Fixed formats of the values looked for; each is checked again after matching.
FORMATS = {
    "email": r"(?<![\w.+%-])[\w.%+-]++@[^\W_](?:[^\W_]|[.-])*+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\w|[.-]\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d\d-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?!(?![Tt]\d|Z\b)[\w/-]|\.\d)",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "secret": r"(?i:(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
    r"(?P<value>[A-Za-z0-9+/_-]{12,})",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items()))
ORDERED = tuple(FORMATS)
ALONE = {k: re.compile(v) for k, v in FORMATS.items()}
DAY_ONE, DAY_END = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal()
DATES = (("-", (0, 1, 2)), ("/", (2, 0, 1)), (".", (2, 1, 0)))


def permuted(value: int, size: int, key: bytes, use: str) -> int:
    """A keyed permutation of range(size); `use` separates formats."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    wide = (a.bit_length() + 7) // 8 + 8

    def turn(k: int, x: int) -> int:
        said = f"{use}|{size}|{k}|{x}".encode()
        out = blake2b(said, key=key, digest_size=min(64, wide)).digest()
        while len(out) < wide:
            out += blake2b(out + said, key=key).digest()
        return int.from_bytes(out[:wide], "big")

    while True:
        left, right = divmod(value, b)
        for k in range(0, ROUNDS, 2):
            left = (left + turn(k, right)) % a
            right = (right + turn(k + 1, left)) % b
        value = left * b + right
        if value < size:
            return value


@lru_cache(1 << 12)
def alike(ch: str) -> str:
    """The signs that ch may become: digits, letters of its case, others from its block of 64; none for other signs."""
    if not ch.isalnum():
        return ""
    if ch.isascii():
        return next(x for x in (string.digits, string.ascii_uppercase, string.ascii_lowercase) if ch in x)
    kind = lambda x: (x.isalpha(), x.isupper(), x.islower(), x.isalnum(), x.isascii())
    return "".join(x for x in map(chr, range(ord(ch) & ~63, (ord(ch) | 63) + 1)) if kind(x) == kind(ch))


def permuted_signs(text: str, key: bytes, use: str) -> str:
    """Letters and digits permuted within their classes; other signs stay."""
    shape, value, size = [], 0, 1
    for ch in text:
        hit = alike(ch)
        shape.append(hit)
        if hit:
            value, size = value * len(hit) + hit.index(ch), size * len(hit)
    form = "".join(h[0] if h else "-" for h in shape)
    value = permuted(value, size, key, use + form)
    out = []
    for ch, hit in zip(reversed(text), reversed(shape), strict=True):
        if hit:
            value, r = divmod(value, len(hit))
            ch = hit[r]
        out.append(ch)
    return "".join(reversed(out))


def refilled(text: str, signs: str) -> str:
    """text with its letters and digits replaced in order, punctuation kept."""
    rest = iter(signs)
    return "".join(next(rest) if ch.isalnum() else ch for ch in text)


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch)
        total += d if k % 2 else d * 2 - 9 * (d > 4)
    return -total % 10


def mod97(signs: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in signs)) % 97


def _card(found: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = str(permuted(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
    return refilled(found, body + str(luhn(body)))


def _iban(found: str, key: bytes) -> str | None:
    signs = found.replace(" ", "")
    if not 15 <= len(signs) <= 34 or mod97(signs[4:] + signs[:4]) != 1:
        return None
    body = permuted_signs(signs[4:], key, "iban" + signs[:2])
    check = 98 - mod97(body + signs[:2] + "00")
    return refilled(found, f"{signs[:2]}{check:02d}{body}")


def _ssn(found: str, key: bytes) -> str | None:
    a, b, c = (int(x) for x in found.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    areas = 898  # 1 to 899 without 666
    rank = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    rank, c = divmod(permuted(rank, areas * 99 * 9999, key, "ssn"), 9999)
    a, b = divmod(rank, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{b + 1:02d}-{c + 1:04d}"


def _ip(found: str, key: bytes) -> str | None:
    parts = found.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(found: str, key: bytes) -> str | None:
    sign, order = next(x for x in DATES if x[0] in found)
    parts = found.split(sign)
    y, m, d = (int(parts[k]) for k in order)
    if sign == "/" and m > 12:
        order, m, d = (2, 1, 0), d, m
    try:
        day = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not DAY_ONE <= day < DAY_END:
        return None
    new = dt.date.fromordinal(DAY_ONE + permuted(day - DAY_ONE, DAY_END - DAY_ONE, key, "date"))
    out = [""] * 3
    for k, v in zip(order, (new.year, new.month, new.day), strict=True):
        out[k] = str(v).zfill(4 if len(parts[k]) == 4 else 2 if len(parts[k]) == 2 else 1)
    return sign.join(out)


def _phone(found: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 8 <= len(digits) <= 15 and not (found[0] != "+" and len(digits) == 10):
        return None
    keep = re.match(r"\+\d{1,3}(?=[ .(-])|", found)[0]
    front = len(keep) - 1 if keep else 0
    rest = digits[front:]
    new = str(permuted(int(rest), 10 ** len(rest), key, "phone")).zfill(len(rest))
    return refilled(found, digits[:front] + new)


def _email(found: str, key: bytes) -> str | None:
    name, _, host = found.partition("@")
    labels = host.split(".")
    if len(labels) < 2 or not all(labels) or not (2 <= len(labels[-1]) <= 24 and labels[-1].isalpha()):
        return None
    if len(set(map(str.isascii, labels[-1]))) > 1:
        return None
    top = labels.pop()
    host = ".".join(permuted_signs(x, key, "host") for x in labels)
    return f"{permuted_signs(name, key, 'mailbox')}@{host}.{top}"


CHECKED = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date, "phone": _phone}


@lru_cache(1 << 14)
def pseudonym(kind: str, found: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it fails its check."""
    if kind == "secret":
        if not (re.search(r"\d", found) and re.search(r"[A-Za-z]", found)):
            return None
        if re.fullmatch(r"[0-9a-f]+", found):
            n = len(found)
            return format(permuted(int(found, 16), 1 << 4 * n, key, "hex"), f"0{n}x")
        return permuted_signs(found, key, "secret")
    return CHECKED[kind](found, key)


def shorter(kind: str, found: str) -> Iterator[str]:
    """What a value that fails its check may be, without its end: the longest first."""
    if kind == "email":
        name, _, host = found.partition("@")
        labels = host.split(".")
        labels = labels[: labels.index("")] if "" in labels else labels
        for k in range(len(labels) - 1, 0, -1):
            # An end in letters of one script, as in com.2, com-x or com2.
            top = re.match(r"[A-Za-z]{2,24}|[^\W\d_a-zA-Z]{2,24}", labels[k])
            if top:
                yield f"{name}@{'.'.join([*labels[:k], top[0]])}"
    elif kind in ("iban", "phone"):
        for m in reversed(list(re.finditer(r"[ .-]", found))):
            if ALONE[kind].fullmatch(found[: m.start()]):
                yield found[: m.start()]


def replaced(kind: str, m: re.Match, key: bytes) -> tuple[int, int, str] | None:
    """Start, end and pseudonym of the value in a match, or None if none passes its check."""
    found = m["value"] if kind == "secret" else m[0]
    start = m.end() - len(found)
    if kind == "email":
        bare = found.lstrip(".%+-")
        start, found = start + len(found) - len(bare), bare
        if not any(map(str.isalnum, found.partition("@")[0])):
            return None
    for value in chain([found], shorter(kind, found)):
        new = pseudonym(kind, value, key)
        if new is not None:
            return start, start + len(value), new
    return None


def hidden(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind were put in.

    Where a match fails its check, the kinds after it are tried at the same place
    and all kinds within it.
    """
    counts: dict[str, int] = {}
    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        start = m.start()
        first = next(k for k in KINDS if m[k])
        hit, kind = replaced(first, m, key), first
        for kind in () if hit else ORDERED[ORDERED.index(first) + 1 :]:
            other = ALONE[kind].match(text, start)
            hit = other and replaced(kind, other, key)
            if hit:
                break
        if not hit:
            at = start + 1
            continue
        counts[kind] = counts.get(kind, 0) + 1
        out += [text[done : hit[0]], hit[2]]
        done = at = hit[1]
    return "".join([*out, text[done:]]), counts


def pseudonymised(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text, n_found and a count for each kind.

    key: a secret of at least 16 bytes; who has it can undo the pseudonyms.

    text is the whole text with pseudonyms; null stays null with counts of 0, and
    a text without such values comes out as it was. Repeated rows are treated
    alike; an empty table gives an empty result; other columns are not looked at.
    Long texts are searched whole, in one pass.
    """

    if len(key) < 16:
        raise ValueError("the key must have 16 bytes or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for value, may in zip(batch.column(1), batch.column(2), strict=True):
                body = value.as_py()
                got = hidden(body, key) if may.as_py() else (body, {})
                out.append(got[0])
                counts.append(got[1])
            columns = [batch.column(0), pa.array(out, pa.string())]
            columns.append(pa.array([sum(c.values()) for c in counts], pa.int64()))
            columns += [pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in KINDS]
            names = [batch.schema.names[0], "text", "n_found", *[f"n_{k}" for k in KINDS]]
            yield pa.RecordBatch.from_arrays(columns, names)

    # A text without a digit or a sign for mail holds none of the formats.
    may = F.coalesce(F.col(text).rlike(r"[0-9@]"), F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), may.alias("may"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, text string, n_found bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(run, shape)

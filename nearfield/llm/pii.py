"""PII: format-preserving pseudonyms by a keyed Feistel network.

Validated values (card numbers, IBANs, social security numbers, phone numbers,
IPv4 addresses, dates, e-mail addresses, hexadecimal secrets, access keys) are numbered
within the set of values of their format, the number is permuted by a keyed
Feistel network on that set (with cycle walking, so that it stays a
permutation), and the result is written in the same format: punctuation, case
and check digits hold. Equal values have equal pseudonyms in all documents, and
different ones different; the key undoes it. A phone number has one pseudonym
with and without the country code 1, an e-mail address one for all spellings of
upper and lower case; hosts and key prefixes stay, so that format and issuer do.

Defined results: null stays null, empty texts stay empty; what fails its
validation (a card number's or an IBAN's check digits, a date that no calendar
has, an octet over 255) is not a value of that kind and stays. Of overlapping
values the leftmost is replaced, and at one place the kind that stands first in
``KINDS``. Of the places between groups where a card number or an IBAN may end,
the last valid one counts. A date with the day in the middle is one if the day is
over 12, else the day is first. Rows that repeat get equal results.

The key undoes each value. In a text, what follows a card number or an IBAN
without more than a space can by chance be valid together with its pseudonym
(about once in 10 and 97 times), and would be undone together with it.
"""

from __future__ import annotations

import datetime
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 10


class Permutation:
    """Keyed permutations of range(size), one for each kind and size."""

    def __init__(self, key: bytes):
        if not 16 <= len(key) <= 64:
            raise ValueError("a key has 16 to 64 bytes")
        self.key = key

    def _round(self, kind: str, size: int, i: int, half: int, bits: int) -> int:
        said = f"{kind}|{size}|{i}|{half}".encode()
        digest = hashlib.blake2b(said, key=self.key, digest_size=-(-bits // 8)).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _once(self, kind: str, size: int, x: int, bits: int, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(kind, size, i, left, bits), left
            else:
                left, right = right, left ^ self._round(kind, size, i, right, bits)
        return left << bits | right

    def move(self, kind: str, size: int, x: int, back: bool = False, valid: Callable[[int], bool] = lambda x: True) -> int:
        """Where x goes; steps until the result is in range and valid, which keeps it a permutation of the valid."""
        bits = max(2, -(-(max(2, size) - 1).bit_length() // 2))
        while True:
            x = self._once(kind, size, x, bits, back)
            if x < size and valid(x):
                return x


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(found: str, p: Permutation, back: bool) -> str | None:
    digits = _digits(found)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    n = len(digits) - 1
    body = f"{p.move('card', 10**n, int(digits[:-1]), back):0{n}d}"
    return _refill(found, body + str(luhn(body)))


def _ssn(found: str, p: Permutation, back: bool) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    x = int(_digits(found))
    return _refill(found, f"{p.move('ssn', 10**9, x, back, valid):09d}") if valid(x) else None


def _phone(found: str, p: Permutation, back: bool) -> str | None:
    digits = _digits(found)
    if not 10 <= len(digits) <= 15:
        return None
    head = digits[:-10]
    plan = "" if head == "1" else head
    return _refill(found, head + f"{p.move('phone' + plan, 10**10, int(digits[-10:]), back):010d}")


def _ip(found: str, p: Permutation, back: bool) -> str | None:
    parts = found.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = p.move("ip", 2**32, int.from_bytes(bytes(map(int, parts)), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(found: str, p: Permutation, back: bool) -> str | None:
    sep = found[4] if found[4] in "-/." else found[2]
    parts = found.split(sep)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 0, 1) if int(parts[1]) > 12 else (2, 1, 0)
    try:
        at = datetime.date(*(int(parts[i]) for i in order)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= at <= _LAST:
        return None
    # with the day in the middle it stays over 12, so that it is read so again
    valid = (lambda x: datetime.date.fromordinal(_FIRST + x).day > 12) if order == (2, 0, 1) else (lambda x: True)
    to = datetime.date.fromordinal(_FIRST + p.move("date", _LAST - _FIRST + 1, at - _FIRST, back, valid))
    out = [""] * 3
    for i, new in zip(order, (f"{to.year:04d}", f"{to.month:02d}", f"{to.day:02d}")):
        out[i] = new
    return sep.join(out)


def _by_class(text: str, kind: str, p: Permutation, back: bool, radix: Callable[[str], tuple[int, str] | None]) -> str:
    """Permute the characters that have a class among the texts of the same shape."""
    x, size, classes = 0, 1, [radix(c) for c in text]
    for c, own in zip(text, classes):
        if own:
            x, size = x * own[0] + own[1].index(c), size * own[0]
    if size == 1:
        return text
    shape = "".join(c if own is None else own[1][0] for c, own in zip(text, classes))
    x = p.move(f"{kind}|{shape}", size, x, back)
    out = []
    for c, own in reversed(list(zip(text, classes))):
        if own:
            x, d = divmod(x, own[0])
            c = own[1][d]
        out.append(c)
    return "".join(reversed(out))


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _alnum(c: str) -> tuple[int, str] | None:
    return next(((len(s), s) for s in _SETS if c in s), None)


def _email(found: str, p: Permutation, back: bool) -> str | None:
    local, _, host = found.rpartition("@")
    new = _by_class(local.lower(), "email|" + host.lower(), p, back, _alnum)
    return "".join(c.upper() if o.isupper() else c for c, o in zip(new, local)) + f"@{host}"


def _secret(found: str, p: Permutation, back: bool) -> str | None:
    if found.isdigit() or found.isalpha() or (found != found.lower() and found != found.upper()):
        return None
    digits = "0123456789abcdef" if found == found.lower() else "0123456789ABCDEF"
    return _by_class(found, "secret", p, back, lambda c: (16, digits))


def _access_key(found: str, p: Permutation, back: bool) -> str | None:
    head = _KEY_HEAD.match(found).group()
    return head + _by_class(found[len(head) :], f"key|{head}", p, back, _alnum)


def _iban_check(country: str, bban: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{bban}{country}00")) % 97


def _iban(found: str, p: Permutation, back: bool) -> str | None:
    plain = found.replace(" ", "")
    country, check, bban = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(bban) <= 30 or int(check) != _iban_check(country, bban):
        return None
    new = _by_class(bban, "iban" + country, p, back, _alnum)
    it = iter(f"{country}{_iban_check(country, new):02d}{new}")
    return "".join(" " if c == " " else next(it) for c in found)


# How access keys of well-known issuers begin.
_KEY_HEAD = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abpr]-")

#: Kinds in the order in which they are tried at one place, with what they look like.
KINDS: dict[str, tuple[str, Callable[[str, Permutation, bool], str | None]]] = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "secret": (r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])", _secret),
    "key": (r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abpr]-[A-Za-z0-9-]{20,64})(?![A-Za-z0-9])", _access_key),
    "ip": (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])", _ip),
    "date": (r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9])", _date),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    "phone": (r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", _phone),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
}

#: Characters between the groups of kinds that may end before the run does.
_BREAKS = {"card": " -", "iban": " "}


class Pseudonymizer:
    def __init__(self, key: bytes, kinds: tuple[str, ...] = tuple(KINDS)):
        self.permutation = Permutation(key)
        numbers = [k for k in kinds if k != "email"]
        self.patterns = {k: re.compile(KINDS[k][0]) for k in kinds}
        self.starts = re.compile(r"[0-9]")
        self.numbers, self.email = numbers, "email" in kinds
        self.order = {k: i for i, k in enumerate(KINDS)}

    def _next(self, kind: str, text: str, at: int, back: bool) -> tuple[int, int, int, str, str] | None:
        """(start, order, end, kind, pseudonym) of the first valid value from ``at`` on."""
        look, new_of = self.patterns[kind], KINDS[kind][1]
        while m := look.search(text, at):
            found, breaks = m.group(), _BREAKS.get(kind, "")
            for end in (len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] in breaks)):
                new = new_of(found[:end], self.permutation, back)
                if new is not None:
                    return m.start(), self.order[kind], m.start() + end, kind, new
            at = m.start() + 1
        return None

    def replace(self, text: str, back: bool = False) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds of the values replaced."""
        own = (self.numbers if self.starts.search(text) else []) + (["email"] if self.email and "@" in text else [])
        ahead = [n for k in own if (n := self._next(k, text, 0, back))]
        heapq.heapify(ahead)
        out, kinds, at = [], [], 0
        while ahead:
            start, _, end, kind, new = heapq.heappop(ahead)
            if start >= at:
                out += [text[at:start], new]
                kinds.append(kind)
                at = end
            if n := self._next(kind, text, at, back):
                heapq.heappush(ahead, n)
        out.append(text[at:])
        return "".join(out), kinds


def pseudonymize(docs: DataFrame, key: bytes, kinds: tuple[str, ...] = tuple(KINDS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, kinds array<string>) for each row; a map over the rows, without a shuffle."""
    common.session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonymizer(key, kinds)
        for batch in batches:
            texts, found = [], []
            for text in batch.column(1).to_pylist():
                new, hit = own.replace(text) if text else (text, [])
                texts.append(new)
                found.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "text", "kinds"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, text string, kinds array<string>")

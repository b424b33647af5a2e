"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Values are found by pattern and validated: card numbers by Luhn, IBANs by mod 97,
social-security numbers by their reserved ranges, addresses by octet, dates by the
calendar.  A valid value is mapped to a number within its format, permuted by a keyed
Feistel network over just that many numbers (unbalanced halves a x b, cycle walking
back into the range), and written in the form it had; check digits are computed anew.
The permutation depends on key and format only, so equal values have equal pseudonyms
in all documents, different values different ones, and the holder of the key can
invert them.  The form of phone numbers, cards and dates does not matter: the same
number written in another way stays linked.

The key is a parameter; the default is for tests.

Domains of e-mail addresses are permuted label by label, but for the last; IPv6 addresses
digit by digit in the form they have; phone numbers in their last ten digits, so that a
number with and without its country code stays linked; keys of known services behind
their prefix.

Defined results.  A null text stays null, an empty one empty; texts without valid
values come back unchanged.  Very long texts are read whole.  Rows are independent, so
repeated rows and ids, and null ids, are harmless; all columns are kept, but a column
named ``_pii_kinds`` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache, partial
from hashlib import blake2b
from ipaddress import ip_address
from math import isqrt

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.llm.common import slices, table

TEST_KEY = "key for tests only"
ROUNDS = 8
_HEX = "0123456789abcdef"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Feistel:
    """Keyed permutations of 0 .. n - 1, one for each (name, n)."""

    def __init__(self, key: str) -> None:
        self.key = blake2b(key.encode(), digest_size=32).digest()

    def _round(self, name: str, n: int, i: int, half: int, mod: int) -> int:
        size = (mod.bit_length() + 7) // 8 + 8
        data = f"{name}|{n}|{i}|{half}".encode()
        out, block = b"", 0
        while len(out) < size:
            out += blake2b(data + b"|%d" % block, key=self.key, digest_size=32).digest()
            block += 1
        return int.from_bytes(out[:size], "big") % mod

    def _once(self, name: str, n: int, x: int, sign: int) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            if i % 2:
                right = (right + sign * self._round(name, n, i, left, b)) % b
            else:
                left = (left + sign * self._round(name, n, i, right, a)) % a
        return left * b + right

    def permute(self, name: str, n: int, x: int, allowed: Callable[[int], bool] | None = None, sign: int = 1) -> int:
        """The image of x (of its preimage, with sign -1); walks on while outside the range or not allowed."""
        if n < 2:
            return x
        while True:
            x = self._once(name, n, x, sign)
            if x < n and (allowed is None or allowed(x)):
                return x


def luhn_digit(body: str) -> int:
    """The check digit that makes body + digit valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return -total % 10


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _refill(form: str, digits: str) -> str:
    """Put digits in place of those of form."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _valid_date(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d) if 1900 <= y < 2100 else None
    except ValueError:
        return None


#: Characters of an IBAN by country.
_IBAN_LENGTH = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}  # fmt: skip
_FIRST, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


class Pseudonyms:
    """Replaces valid personal values in texts; ``sign=-1`` inverts."""

    def __init__(self, key: str, sign: int = 1) -> None:
        self.f, self.sign = Feistel(key), sign
        self.known: dict[tuple[str, str], str | None] = {}

    def letters(self, name: str, s: str) -> str:
        """Permute a string among those with digits, small and capital letters in the same places."""
        classes = [next((c for c in (_DIGITS, _LOWER, _UPPER) if x in c), x) for x in s]
        n = x = 0
        n = 1
        for c, among in zip(s, classes, strict=True):
            n, x = n * len(among), x * len(among) + among.index(c)
        x = self.f.permute(f"{name}:{''.join(c[0] for c in classes)}", n, x, sign=self.sign)
        out = []
        for among in reversed(classes):
            x, at = divmod(x, len(among))
            out.append(among[at])
        return "".join(reversed(out))

    def email(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        *labels, last = domain.split(".")
        return f"{self.letters('email', local)}@{'.'.join([*(self.letters('domain', x) for x in labels), last])}"

    def phone(self, s: str) -> str | None:
        digits = "".join(c for c in s if c.isdigit())
        country = regex.match(r"\+(\d{1,3})(?!\d)", s)
        keep = max(len(country[1]) if country else 0, len(digits) - 10)
        head, body = digits[:keep], digits[keep:]
        if not 7 <= len(body) or len(digits) > 15 or (len(body) < 10 and not country):
            return None
        name = "phone" if len(body) == 10 else f"phone{len(body)}"
        return _refill(s, head + f"{self.f.permute(name, 10 ** len(body), int(body), sign=self.sign):0{len(body)}d}")

    def card(self, s: str) -> str | None:
        digits = "".join(c for c in s if c.isdigit())
        if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != int(digits[-1]):
            return None
        n = len(digits) - 2
        body = digits[0] + f"{self.f.permute('card', 10**n, int(digits[1:-1]), sign=self.sign):0{n}d}"
        return _refill(s, body + str(luhn_digit(body)))

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
            return None
        body = self.letters("iban" + plain[:2], plain[4:])
        check = 98 - _iban_rest(plain[:2] + "00" + body)
        it = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in s)

    def _end(self, kind: str, s: str) -> int:
        """Where the valid value ends that starts the candidate; 0 without any.  An IBAN may end before any space: at its country's length, else as late as possible."""
        if kind != "iban":
            return len(s) if self._replaced(kind, s) is not None else 0
        ends = [i for i in range(len(s), 0, -1) if i == len(s) or s[i] == " "]
        ends.sort(key=lambda i: i - s.count(" ", 0, i) != _IBAN_LENGTH.get(s[:2]))
        return next((i for i in ends if self._replaced(kind, s[:i]) is not None), 0)

    def ssn(self, s: str) -> str | None:
        def allowed(x: int) -> bool:
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        x = int(s.replace("-", ""))
        return _refill(s, f"{self.f.permute('ssn', 10**9, x, allowed, self.sign):09d}") if allowed(x) else None

    def address(self, s: str) -> str | None:
        octets = [int(x) for x in s.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        x = self.f.permute("address", 1 << 32, int.from_bytes(bytes(octets), "big"), sign=self.sign)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ipv6(self, s: str) -> str | None:
        digits = s.replace(":", "")
        try:
            ip_address(s)
        except ValueError:
            return None
        if len(digits) < 8 or not any(c in _DIGITS for c in digits):
            return None
        upper = digits != digits.lower()
        if upper and digits != digits.upper():
            return None
        new = f"{self.f.permute(f'ipv6{len(digits)}', 16 ** len(digits), int(digits, 16), lambda x: any(c in _DIGITS for c in f'{x:0{len(digits)}x}') and any(c in 'abcdef' for c in f'{x:0{len(digits)}x}') == any(c in 'abcdefABCDEF' for c in digits), self.sign):0{len(digits)}x}"
        it = iter(new.upper() if upper else new)
        return "".join(c if c == ":" else next(it) for c in s)

    def day(self, s: str) -> str | None:
        parts = regex.split(r"[-/.]", s)
        sep = s[len(parts[0])]
        year_first = len(parts[0]) == 4
        y, m, d = map(int, parts) if year_first else map(int, reversed(parts))
        month_first = not year_first and m > 12
        if month_first:
            m, d = d, m
        found = _valid_date(y, m, d)
        if not found:
            return None
        # a day beyond 12 keeps the order of day and month plain, so the walk stays within such dates
        plain = (lambda x: date.fromordinal(_FIRST + x).day > 12) if found.day > 12 else (lambda x: date.fromordinal(_FIRST + x).day <= 12)
        new = date.fromordinal(_FIRST + self.f.permute("date", _DAYS, found.toordinal() - _FIRST, plain, self.sign))
        if year_first:
            return f"{new.year}{sep}{new.month:02d}{sep}{new.day:02d}"
        return f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year}" if month_first else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year}"

    def secret(self, s: str) -> str:
        if len(s) >= 32 and set(s) <= set(_HEX):
            n = len(s)
            return f"{self.f.permute('hex', 16**n, int(s, 16), sign=self.sign):0{n}x}"
        known = regex.match(r"AKIA|AIza|gh[pousr]_|sk-|xox[abprs]-", s)
        head = known.end() if known else 0
        return s[:head] + self.letters("secret", s[head:])

    _RULES = (
        ("email", r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
        ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,72}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])|(?<=\bpassword=)[A-Za-z0-9]{8,64}(?![A-Za-z0-9])|(?<=[\"'])[0-9a-f]{32,64}(?=[\"'])"),
        ("card", r"(?<![\d.+-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\d-]|\.\d)"),
        ("day", r"(?<![\d./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d/-]|\.\d)"),
        ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<=\b(?:SSN|ssn)[:# ]{1,3})\d{9}(?![\d-])"),
        ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:]|\.\w)"),
        ("address", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"),
        ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+[1-9]\d{0,2}(?:[ .-]?\(0?\d{1,4}\))?(?:[ .-]\d{1,8}){1,5}(?!\d)|(?<![\d+./-])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d-]|\.\d)"),
    )
    _FOUND = regex.compile("|".join(f"(?P<{k}>{p.replace(chr(92) + '1', '(?P=s1)').replace(chr(92) + '2', '(?P=s2)').replace('([-/.])', '(?P<s1>[-/.])', 1).replace('([-/.])', '(?P<s2>[-/.])', 1) if k == 'day' else p})" for k, p in _RULES))
    _KINDS = frozenset(k for k, _ in _RULES)
    _ANY = regex.compile(r"[0-9@]|password=")

    def _replaced(self, kind: str, value: str) -> str | None:
        known = self.known.get((kind, value), 0)
        if known == 0:
            if len(self.known) > 20_000:
                self.known.clear()
            known = self.known[kind, value] = getattr(self, kind)(value)
        return known

    def apply(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds replaced in order."""
        if not self._ANY.search(text):
            return text, []
        out, at, kinds, pos = [], 0, [], 0
        failed: list[tuple[str, int, int]] = []
        while m := self._FOUND.search(text, pos):
            kind, start = m.lastgroup if m.lastgroup in self._KINDS else "day", m.start()
            end = start + self._end(kind, m[0])
            if end == start:
                # another value may begin within the candidate
                failed.append((kind, start, m.end()))
                pos = start + 1
                continue
            old, tail = text[start:end], text[end : m.end()]
            new = self._replaced(kind, old)
            over = [(k, text[max(a, at) : start], b) for k, a, b in failed if b > start]
            # walk on while the text around would be read otherwise than before, so that it can be inverted
            while (tail and self._end(kind, new + tail) != len(old)) or any(self._end(k, head + (new + text[end:b] if b > end else new[: b - start])) for k, head, b in over):
                new = self._replaced(kind, new)
            out += [text[at:start], new]
            at = pos = end
            failed = []
            kinds.append(kind)
        return ("".join(out) + text[at:], kinds) if kinds else (text, [])


@lru_cache(maxsize=4)
def _worker(key: str, sign: int) -> Pseudonyms:
    return Pseudonyms(key, sign)


def _applied(batches: Iterator[pa.RecordBatch], key: str, sign: int) -> Iterator[pa.RecordBatch]:
    names = _worker(key, sign)
    for batch in slices(batches):
        at = batch.schema.names.index("text")
        done = [names.apply(x) if x is not None else (None, []) for x in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array([t for t, _ in done], pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array([k for _, k in done], pa.list_(pa.string()))], names=[*batch.schema.names, "_pii_kinds"])


def pseudonymise(docs: DataFrame, *, key: str = TEST_KEY, invert: bool = False) -> DataFrame:
    """The rows of ``docs`` with pseudonyms in ``text``, and the kinds replaced in ``_pii_kinds``."""
    docs = docs.drop("_pii_kinds")
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(partial(_applied, key=key, sign=-1 if invert else 1), f"{fields}, _pii_kinds array<string>")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: ``doc_id, text, n_replaced, kinds`` (kinds sorted, each once, joined by commas)."""
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("_pii_kinds").cast("long").alias("n_replaced"), F.array_join(F.sort_array(F.array_distinct("_pii_kinds")), ",").alias("kinds"))

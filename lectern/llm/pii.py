"""Format-preserving pseudonyms: a keyed Feistel permutation within the format of each validated value.

Equal values get equal pseudonyms in every document, as the permutation depends on the key, the kind and the value
alone; no table of values is kept or shuffled. Values are validated before they are touched:

* payment cards: 13 to 19 digits with a right Luhn digit; all digits but the last are permuted, the last is recomputed
* IBANs: right check digits, without words that follow and could be groups; digits and letters of the account are permuted in their class, check digits recomputed
* telephone numbers (+1 and ten digits with valid area and exchange codes; other +country numbers by digit)
* social security numbers with valid areas; IPv4 addresses with octets up to 255
* dates (year-month-day, day.month.year, day/month/year) that exist, 1900 to 2099: permuted as day numbers
* e-mail addresses: letters and digits of the local part, in their classes; secrets after token, key, password, secret

Permutations of small formats walk the cycle until the result is valid again, so all are one to one.

Nulls: a null text stays null and counts 0; an empty one stays empty. Repeated rows are treated each. An empty table
gives no row. All other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .util import kept as kept_by_worker, pieces

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email", "secret")

#: One pass over a text; the order is that of precedence at the same place. Digits are ASCII ones, and so are the letters
#: of an IBAN, without those that Unicode folds to ASCII: values of other digits or letters are left alone.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>\b(?:token|api[_-]?key|secret|password|passwd|access[_-]?key)[\"']?\s*[:=]\s*[\"']?(?P<value>[A-Za-z0-9_\-+/]{6,}))"
    r"|(?P<iban>\b(?-i:[A-Za-z]{2}[0-9][0-9](?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?)\b)"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![\w.(-])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9][0-9]-[0-9]{4}(?![\w-]))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9][0-9]-[0-9][0-9]|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9]))",
    re.IGNORECASE,
)
#: A text without these holds none of the kinds: an address has an @, a secret a mark after its name, all others a digit.
HINT = re.compile(r"[0-9]|@|[:=]")
#: Characters of an IBAN by country. The public register.
IBAN_LENGTHS = {k[:2]: int(k[2:]) for k in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


class Feistel:
    """Permutations of integers below n: ten rounds over two halves with modular addition, cycle-walked into range."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32, person=b"pseudonym").digest()

    def _round(self, tweak: str, n: int, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{i}|{x}".encode(), key=self.key, digest_size=16).digest(), "big")

    def _once(self, tweak: str, n: int, a: int, b: int, x: int) -> int:
        left, right = divmod(x, b)
        for i in range(0, 10, 2):
            left = (left + self._round(tweak, n, i, right)) % a
            right = (right + self._round(tweak, n, i + 1, left)) % b
        return left * b + right

    def permute(self, tweak: str, n: int, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        if n < 2:
            return x
        b = int(n**0.5) + 1
        a = -(-n // b)
        while True:
            x = self._once(tweak, n, a, b, x)
            if x < n and valid(x):
                return x

    def spelt(self, tweak: str, value: str) -> str:
        """Permutes letters and digits in their classes; anything else stays in place."""
        classes = [next((c for c in (DIGITS, LOWER, UPPER) if ch in c), "") for ch in value]
        n, x = 1, 0
        for ch, c in zip(value, classes):
            if c:
                n, x = n * len(c), x * len(c) + c.index(ch)
        y, out = self._wide(tweak + "|" + "".join("." if not c else c[0] for c in classes), n, x), []
        for ch, c in zip(reversed(value), reversed(classes)):
            if c:
                y, k = divmod(y, len(c))
                out.append(c[k])
            else:
                out.append(ch)
        return "".join(reversed(out))

    def _wide(self, tweak: str, n: int, x: int) -> int:
        """As permute, for integers of any size: halves by bits."""
        if n < 1 << 64:
            return self.permute(tweak, n, x)
        half = (n.bit_length() + 1) // 2
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for i in range(10):
                f = int.from_bytes(hashlib.shake_256(self.key + f"{tweak}|{i}|{right}".encode()).digest(half // 8 + 9), "big")
                left, right = right, (left + f) & mask
            x = left << half | right
            if x < n:
                return x


def luhn_digit(digits: str) -> int:
    total = sum(int(d) if k % 2 else int(d) * 2 - 9 * (d > "4") for k, d in enumerate(reversed(digits)))
    return -total % 10


def iban_checks(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account.upper() + country.upper() + "00"))
    return f"{98 - number % 97:02d}"


def iban_endings(s: str) -> list[int]:
    """Where an IBAN at the beginning of a match may end, as words after it can look like its groups: at the length of its country first, then the longest first."""
    ends = [k for k in range(len(s), 0, -1) if (k == len(s) or s[k] == " ") and k - s.count(" ", 0, k) >= 12]
    own = IBAN_LENGTHS.get(s[:2].upper())
    return sorted(ends, key=lambda k: k - s.count(" ", 0, k) != own)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.f = Feistel(key)
        self.value = lru_cache(maxsize=50_000)(self._value)

    @staticmethod
    def _fill(shape: str, chars: str) -> str:
        it = iter(chars)
        return "".join(next(it) if c.isalnum() else c for c in shape)

    def _value(self, kind: str, s: str) -> str | None:
        """The pseudonym of a value; None if it isn't a valid one of its kind."""
        f, digits = self.f, "".join(c for c in s if c in DIGITS)
        if kind == "card":
            if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
                return None
            body = f.spelt("card", digits[:-1])
            return self._fill(s, body + str(luhn_digit(body)))
        if kind == "iban":
            compact = s.replace(" ", "")
            if not compact[4:] or iban_checks(compact[:2], compact[4:]) != compact[2:4]:
                return None
            body = f.spelt("iban", compact[4:])
            return self._fill(s, compact[:2] + iban_checks(compact[:2], body) + body)
        if kind == "phone":
            plain = digits[-10:] if digits[:-10] in ("", "1") else ""
            if len(plain) == 10:
                if plain[0] < "2" or plain[3] < "2":
                    return None
                x = f.permute("phone", 10**10, int(plain), lambda y: y >= 2 * 10**9 and y // 10**6 % 10 >= 2)
                return self._fill(s, digits[:-10] + f"{x:010d}")
            if not 8 <= len(digits) <= 15 or not s.startswith("+"):
                return None
            country = re.match(r"\+([0-9]{1,3}?)(?=[ .(-]|[0-9]{7})", s)
            keep = len(country[1]) if country else 1
            return self._fill(s, digits[:keep] + f.spelt("phone+" + digits[:keep], digits[keep:]))
        if kind == "ssn":
            fine = lambda y: y // 10**6 not in (0, 666) and y // 10**6 < 900 and y // 10**4 % 100 and y % 10**4
            return self._fill(s, f"{f.permute('ssn', 10**9, int(digits), fine):09d}") if fine(int(digits)) else None
        if kind == "ip":
            octets = [int(x) for x in s.split(".")]
            if max(octets) > 255 or octets[0] == 0:
                return None
            x = f.permute("ip", 1 << 32, int.from_bytes(bytes(octets), "big"), lambda y: y >> 24 > 0)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "date":
            mark = next(c for c in s if c in "-./")
            a, b, c = map(int, s.split(mark))
            first = mark == "/" and a <= 12
            y, m, d = (a, b, c) if mark == "-" else (c, a, b) if first else (c, b, a)
            try:
                day = date(y, m, d)
            except ValueError:
                return None
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            n = (LAST_DAY - FIRST_DAY).days + 1
            fits = (lambda k: (FIRST_DAY + timedelta(k)).day <= 12) if first and b <= 12 else (lambda k: (FIRST_DAY + timedelta(k)).day > 12) if mark == "/" else (lambda _: True)
            new = FIRST_DAY + timedelta(f.permute("date" if mark != "/" else f"date/{b <= 12}{first}", n, (day - FIRST_DAY).days, fits))
            wide = "02d" if len(s) == 10 else "d"
            return f"{new.year:04d}-{new.month:02d}-{new.day:02d}" if mark == "-" else mark.join(format(v, wide) for v in ((new.month, new.day) if first else (new.day, new.month))) + f"{mark}{new.year:04d}"
        if kind == "email":
            local, _, domain = s.rpartition("@")
            return f.spelt("email", local) + "@" + domain
        return f.spelt("secret", s)

    def text(self, text: str | None) -> tuple[str | None, list[int]]:
        counts = [0] * len(KINDS)
        if not text or not HINT.search(text):
            return text, counts

        def one(m: re.Match) -> tuple[str, int]:
            """What replaces the text from the beginning of the match on, and up to where."""
            kind = m.lastgroup if m.lastgroup != "value" else "secret"
            if kind == "iban":
                for k in iban_endings(m[0]):
                    new = self.value(kind, m[0][:k])
                    if new is not None:
                        counts[KINDS.index(kind)] += 1
                        return new, m.start() + k
                return m[0][0], m.start() + 1  # other kinds may begin inside
            s = m["value"] if kind == "secret" else m[0]
            new = self.value(kind, s)
            if new is None and kind in ("phone", "ssn", "date"):  # perhaps a card in another spelling
                n = "".join(c for c in s if c in DIGITS)
                kind, new = ("card", self.value("card", s)) if 13 <= len(n) <= 19 else (kind, None)
            if new is None:
                return m[0], m.end()
            counts[KINDS.index(kind)] += 1
            return m[0][: m.start("value") - m.start()] + new + m[0][m.end("value") - m.start() :] if kind == "secret" else new, m.end()

        out, at = [], 0
        while m := PATTERN.search(text, at):
            new, end = one(m)
            out += text[at : m.start()], new
            at = end
        return "".join(out) + text[at:], counts


def pseudonymise(docs: DataFrame, key: bytes, column: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with ``column`` pseudonymised and, if asked, a count column ``n_<kind>`` for each kind.

    The key belongs to the caller and is never derived from the data. A column of ``docs`` that has the name of a count
    column is replaced by it.
    """
    names = [f"n_{k}" for k in KINDS] if counts else []
    kept = [f for f in docs.schema.fields if f.name not in names]
    at = [f.name for f in kept].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_by_worker((Pseudonyms, key), lambda: Pseudonyms(key))
        for b in pieces(batches, at):
            done = [own.text(t) for t in b.column(at).to_pylist()]
            cols = [pa.array([x for x, _ in done], pa.string()) if k == at else b.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([c[k] for _, c in done], pa.int64()) for k in range(len(names))], names=[str(i) for i in range(len(kept) + len(names))])

    rows = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    schema = StructType([*rows.schema.fields, *[StructField(n, LongType()) for n in names]])
    return rows.mapInArrow(run, schema).toDF(*[f.name for f in kept], *names)

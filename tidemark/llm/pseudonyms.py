"""Format-preserving pseudonyms for personal values in text.

Values are found by form and validated (card numbers by their check digit, dates by the
calendar, addresses by range, account numbers by modulus 97), then moved by a keyed
permutation within their own format: a Feistel network over the values of that format,
walked until the result is valid again. Equal values get equal pseudonyms in all documents
whatever their separators, different values get different ones, and who holds the key can
go back (up to leading zeros of dates). Numbers that fail validation are ordinary text and stay.

It is one pass without a shuffle; only the surroundings of a digit, `@`, `=` or `:` are searched.

Cases: a null text stays null and an empty one empty; texts are searched whole; repeated
rows are treated alike; an empty table gives no row; other columns are carried along.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "example key, to be replaced"
ROUNDS = 8

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join(MONTHS)
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049  # to the end of 2099

FORMS = re.compile(
    r"(?P<email>(?<![\w.+-])\w[\w.+-]*@\w[\w-]*(?:\.\w[\w-]*)+)"
    r"|(?P<secret>(?i:\b(?:token|password|passwd|secret|api[_-]?key|access[_-]?key))\b[\"']?\s*[:=]\s*[\"']?(?P<value>[A-Za-z0-9_+/-]{12,}))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<iso>(?<![\d./-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?![\d/-])(?!\.\d))"
    r"|(?P<date>(?<![\d./-])\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}(?![\d/-])(?!\.\d))"
    rf"|(?P<long1>(?<!\d)\d{{1,2}} (?:{_MONTH}) \d{{4}}(?!\d))|(?P<long2>\b(?:{_MONTH}) \d{{1,2}}, \d{{4}}(?!\d))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}(?P<s3>[-.])\d{3}(?P=s3)\d{4}(?![.-]?\d))"
    r"|(?P<card>(?<!\d)(?:\d{4}(?P<s4>[ -])\d{4}(?P=s4)\d{4}(?P=s4)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<digits>(?<!\d)\d{13,19}(?!\d))"
)
DATES = ("iso", "date", "long1", "long2")
KINDS = ("email", "secret", "iban", *DATES, "ip", "ssn", "phone", "card", "digits")
_HINT = re.compile(r"[@=:\d]")
#: Lengths of account numbers by country; of others the longest valid one is taken.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}
_NEAR = 80  # code points around a hint that are searched, to the next white space


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of text with a sign that every form has; forms never reach beyond them."""
    out: list[tuple[int, int]] = []
    for m in _HINT.finditer(text):
        if out and m.start() < out[-1][1] - _NEAR // 2:
            continue
        a, b = max(0, m.start() - _NEAR), min(len(text), m.start() + _NEAR)
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class Permutation:
    """A keyed bijection of 0 .. size-1: a balanced Feistel network, walked until inside."""

    def __init__(self, key: str, tweak: str, size: int) -> None:
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.seed = hashlib.blake2b(key.encode(), digest_size=32).digest() + f"{tweak}:{size}:".encode()

    def _round(self, i: int, x: int) -> int:
        width = (self.half + 7) // 8
        out = hashlib.shake_256(self.seed + bytes([i]) + x.to_bytes(width, "little")).digest(width)
        return int.from_bytes(out, "little") & ((1 << self.half) - 1)

    def _pass(self, x: int) -> int:
        a, b = x >> self.half, x & ((1 << self.half) - 1)
        for i in range(ROUNDS):
            a, b = b, a ^ self._round(i, b)
        return a << self.half | b

    def _back(self, x: int) -> int:
        a, b = x >> self.half, x & ((1 << self.half) - 1)
        for i in reversed(range(ROUNDS)):
            a, b = b ^ self._round(i, a), a
        return a << self.half | b

    def forward(self, x: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        x = self._pass(x)
        while x >= self.size or not valid(x):
            x = self._pass(x)
        return x

    def backward(self, x: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        x = self._back(x)
        while x >= self.size or not valid(x):
            x = self._back(x)
        return x


def luhn_digit(payload: str) -> str:
    twice = [int(c) * 2 for c in reversed(payload)][::2]
    once = [int(c) for c in reversed(payload)][1::2]
    return str(-(sum(d - 9 * (d > 9) for d in twice) + sum(once)) % 10)


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _poured(form: str, digits: str) -> str:
    """The digits in the places of the form's digits; the form's other characters stay."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in form)


class Pseudonyms:
    """Replaces one value at a time; `inverse` takes pseudonyms back."""

    def __init__(self, key: str, inverse: bool = False) -> None:
        self.key, self.way = key, "backward" if inverse else "forward"

    def _move(self, tweak: str, size: int, x: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        return getattr(Permutation(self.key, tweak, size), self.way)(x, valid)

    def _number(self, tweak: str, digits: str, valid: Callable[[str], bool] = lambda s: True) -> str:
        n = len(digits)
        return f"{self._move(tweak, 10**n, int(digits), lambda x: valid(f'{x:0{n}d}')):0{n}d}"

    def _letters(self, tweak: str, text: str) -> str:
        """Letters and digits move within their kind; other characters stay. Hexadecimal stays so."""
        kinds = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        if tweak == "secret" and re.fullmatch(r"[0-9a-f]{12,}|[0-9A-F]{12,}", text) and not text.isdigit():
            kinds = ["0123456789" + ("abcdef" if text == text.lower() else "ABCDEF")]
        of = [next((k for k in kinds if c in k), None) for c in text]
        size, x = 1, 0
        for c, k in zip(text, of, strict=True):
            if k:
                size, x = size * len(k), x * len(k) + k.index(c)
        if size == 1:
            return text
        form = "".join("-" if k is None else k[0] for k in of)

        def spelled(x: int) -> str:
            out = list(text)
            for i in reversed(range(len(text))):
                if of[i]:
                    x, d = divmod(x, len(of[i]))
                    out[i] = of[i][d]
            return "".join(out)

        # A hexadecimal value must not turn into a decimal one, which would be another format.
        mixed = len(kinds) == 1
        return spelled(self._move(f"{tweak}:{kinds[0][-1]}{form}", size, x, lambda x: not mixed or not spelled(x).isdigit()))

    def email(self, s: str) -> str:
        local, _, host = s.partition("@")
        return f"{self._letters('email', local)}@{host}"

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        body = self._number("card", digits[:-1], lambda x: bool(x.strip("0")))
        return _poured(s, body + luhn_digit(body))

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
            return None
        body = self._letters("iban" + plain[:2], plain[4:])
        new = iter(f"{plain[:2]}{98 - mod97(plain[:2] + '00' + body):02d}{body}")
        return "".join(c if c == " " else next(new) for c in s)

    def iban_end(self, s: str) -> int:
        """Where the account number ends in what has its form: at a group's border, best at the length of its country; else 0."""
        ends = [len(s), *[k for k in range(len(s) - 1, 0, -1) if s[k] == " "]]
        ends.sort(key=lambda k: len(s[:k].replace(" ", "")) != IBAN_LENGTH.get(s[:2]))
        valid = lambda plain: 15 <= len(plain) <= 34 and mod97(plain) == 1
        return next((k for k in ends if valid(s[:k].replace(" ", ""))), 0)

    def ip(self, s: str) -> str | None:
        parts = [int(p) for p in s.split(".")]
        if max(parts) > 255:
            return None
        x = self._move("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, s: str) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = s.replace("-", "")
        return _poured(s, self._number("ssn", digits, valid)) if valid(digits) else None

    def phone(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if not 8 <= len(digits) <= 15:
            return None
        code = re.match(r"\+(1(?=\D|\d{10}$)|\d{1,3}(?=\D)|\d{2})", s)
        kept = code.group(1) if code else ""
        # With or without its country code of 1, a number of ten digits is the same number.
        return _poured(s, kept + self._number("phone" + (kept or "1"), digits[len(kept) :]))

    def day(self, y: int, m: int, d: int) -> datetime.date | None:
        try:
            x = (datetime.date(y, m, d) - FIRST_DAY).days
        except ValueError:
            return None
        return FIRST_DAY + datetime.timedelta(days=self._move("date", DAYS, x)) if 0 <= x < DAYS else None

    def iso(self, s: str) -> str | None:
        y, m, d = re.split(r"[-/.]", s)
        new = self.day(int(y), int(m), int(d))
        return new and f"{new.year}{s[4]}{new.month:0{len(m)}d}{s[4]}{new.day:0{len(d)}d}"

    def date(self, s: str) -> str | None:
        a, b, y = re.split(r"[-/.]", s)
        sign = s[len(a)]
        new = self.day(int(y), int(b), int(a))
        if new:
            return f"{new.day:0{len(a)}d}{sign}{new.month:0{len(b)}d}{sign}{new.year}"
        new = self.day(int(y), int(a), int(b))  # month first
        return new and f"{new.month:0{len(a)}d}{sign}{new.day:0{len(b)}d}{sign}{new.year}"

    def long1(self, s: str) -> str | None:
        d, m, y = s.split()
        new = self.day(int(y), MONTHS.index(m) + 1, int(d))
        return new and f"{new.day:0{len(d)}d} {MONTHS[new.month - 1]} {new.year}"

    def long2(self, s: str) -> str | None:
        m, d, y = s.replace(",", "").split()
        new = self.day(int(y), MONTHS.index(m) + 1, int(d))
        return new and f"{MONTHS[new.month - 1]} {new.day:0{len(d)}d}, {new.year}"

    def digits(self, s: str) -> str | None:
        return self.card(s)

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """(new text, spans (kind, start, end) of the values in the old one)."""
        spans, parts, at = [], [], 0
        for first, last in windows(text):
            while m := FORMS.search(text, first, last):
                kind = next(k for k in KINDS if m.group(k) is not None)
                a, b = m.span("value" if kind == "secret" else kind)
                first = m.end()
                if kind == "iban":
                    # Upper-case words after it have the form of its groups; what it leaves is searched again.
                    end = self.iban_end(text[a:b])
                    b = first = a + (end or (text[a:b].find(" ") + 1) or b - a)
                old = text[a:b]
                new = self._letters("secret", old) if kind == "secret" else getattr(self, kind)(old)
                if new is not None:
                    parts += [text[at:a], new]
                    at = b
                    spans.append(("card" if kind == "digits" else "date" if kind in DATES else kind, a, b))
        return "".join(parts) + text[at:], spans


def pseudonymised(docs: DataFrame, key: str = KEY, text_col: str = "text", spans_col: str = "pii_spans", inverse: bool = False) -> DataFrame:
    """`docs` with the values in its texts replaced, and their spans in the old texts (code points)."""
    own = [f for f in docs.schema.fields if f.name != spans_col]
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key, inverse)
        for batch in batches:
            i = batch.schema.get_field_index("text")
            old = batch.column(i)
            done = [(None, []) if t is None else work.replace(t) for t in old.to_pylist()]
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done], spans_type)
            yield batch.set_column(i, "text", pa.array([t for t, _ in done], old.type)).append_column("spans", spans)

    # Plain names inside, so that names of the input cannot clash or need quoting.
    inner = {f.name: "text" if f.name == text_col else f"c{k}" for k, f in enumerate(own)}
    rows = docs.select(*[F.col(f"`{a}`").alias(b) for a, b in inner.items()])
    schema = ", ".join(f"{inner[f.name]} {f.dataType.simpleString()}" for f in own)
    done = rows.mapInArrow(run, f"{schema}, spans array<struct<kind:string,start:int,end:int>>")
    return done.select(*[F.col(b).alias(a) for a, b in inner.items()], F.col("spans").alias(spans_col))


def pseudonyms(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_values, kinds) for every row of `docs`."""
    done = pseudonymised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct(F.col("pii_spans.kind"))), ",").alias("kinds"))

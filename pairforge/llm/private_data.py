"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs and their written-out forms, pairs
of digits as they occur in addresses and numbers, schemes, and words that announce an
identifier. A small deterministic parser for the anchor's kind expands it to the left and
right and validates the result: labels of a domain, parts of an address, check digits.

The four base kinds follow fixed patterns and need no cue. On top of them come written-out
email addresses, IPv6 addresses, phone numbers behind a cue or scheme, international bank
account numbers, and account, passport and insurance numbers behind a cue.
"""

from __future__ import annotations

import functools
import ipaddress
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns

# The kinds in their order (the first four are base kinds), letters and limits.
KINDS = ("email", "ip", "card", "phone", "account")
BASE_KINDS = KINDS[:4]
LOCAL = "abcdefghijklmnopqrstuvwxyz0123456789._%+-"
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)
LOCAL_PHONE_DIGITS = (7, 15)

# Written-out at-signs and dots, as bytes read as Latin-1; the last one is the full-width sign.
AT_FORMS = ("[at]", "(at)", "{at}", "%40", "&#64;", "&#x40;", "&commat;", "ï¼\xa0")
SCHEMES = ("tel:", "sms:", "callto:", "://")
PHONE_CUES = ("phone", "telephone", "tel", "mobile", "cell", "fax", "call", "telefon", "handy", "téléphone", "telefono", "teléfono", "móvil", "portable")
ACCOUNT_CUES = ("account", "acct", "a/c", "konto", "kontonummer", "cuenta", "compte", "passport", "reisepass", "pasaporte", "passeport", "iban")
INSURANCE_CUES = ("ssn", "social security")
# Lengths of international bank account numbers by country.
IBAN_LENGTHS = dict(
    ad=24, ae=23, al=28, at=20, az=28, ba=20, be=16, bg=22, bh=22, br=29, ch=21, cr=22, cy=28, cz=24, de=22, dk=18, do=28,
    ee=20, es=24, fi=18, fo=18, fr=27, gb=22, ge=22, gi=23, gl=18, gr=27, gt=28, hr=21, hu=28, ie=22, il=23, **{"is": 26}, it=27,
    jo=30, kw=30, kz=20, lb=28, li=21, lt=20, lu=20, lv=21, mc=27, md=24, me=22, mk=19, mr=27, mt=31, mu=30, nl=18, no=15,
    pk=24, pl=28, ps=29, pt=25, qa=29, ro=24, rs=22, sa=24, se=24, si=19, sk=24, sm=27, tn=24, tr=26, ua=29, vg=24, xk=20,
)

_DOMAIN = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"[ ().0-9-]++")
_SPELLED = re.compile(r" ?[a-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}|%2e|&#46;) ?[a-z0-9-]++)+")
_TOP = re.compile(r"[a-z]{2,}\Z")
_SIX = re.compile(r"[0-9a-f:.]++")
_AUTHORITY = re.compile(r"(?P<user>[a-z0-9._~%!$&'*+;=-]+:[^\s/@?#]+@)?(?:\[(?P<six>[0-9a-f:.]+)\])?")
_BEHIND = re.compile(r"(?:[ \t]*(?:number|numbers|no|num|nr|nummer|numero|is|my|at|me|us|ist|es|est)\b\.?)*[ \t]*[.:#=]?[ \t]*")
_LOCAL_PHONE = re.compile(r"[(]?[0-9](?:[ ().-]{0,2}[0-9])+")
_VALUE = re.compile(r"[a-z0-9](?:[ -]?[a-z0-9])+")
_INSURANCE = re.compile(r"([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![0-9])")
_IBAN = re.compile(r"[a-z]{2}[0-9]{2}(?: ?[a-z0-9]){11,30}")
_AN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    """Anchor texts with (parser, length)."""
    digits = "0123456789"
    words = {"email": ("@",), "spelled": AT_FORMS, "scheme": SCHEMES, "six": ("::",)}
    words |= {"call": PHONE_CUES, "holder": ACCOUNT_CUES, "insurance": INSURANCE_CUES}
    words |= {"phone": [f"+{d}" for d in digits], "ip": [f"{c}.{d}" for c in digits for d in digits]}
    words |= {"card": [f"{c}{s}{d}" for c in digits for s in ("", " ", "-") for d in digits]}
    machine = ahocorasick.Automaton()
    for parser, texts in words.items():
        for text in texts:
            text = text if text in AT_FORMS else text.encode().decode("latin-1")
            machine.add_word(text, (parser, len(text)))
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def iban(value: str) -> bool:
    """Country, length and check digits of a bank account number without blanks."""
    return IBAN_LENGTHS.get(value[:2]) == len(value) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


class _Scan:
    """Parsers over one text of lower-cased UTF-8 bytes read as Latin-1."""

    def __init__(self, text: str):
        self.text, self.base, self.more = text, [], []
        self.done = {"email": 0, "ip": 0, "card": 0, "six": 0, "iban": 0}

    def run(self) -> None:
        parsers = {n: getattr(self, f"_{n}") for n in ("email", "spelled", "scheme", "six", "call", "holder", "insurance", "phone", "ip", "card")}
        for last, (parser, length) in _anchors().iter(self.text):
            parsers[parser](last + 1 - length, last + 1)

    def _left(self, start: int, at: int) -> int:
        """Where the local part that ends at ``at`` begins; not before ``start``."""
        return start + len(self.text[start:at].rstrip(LOCAL))

    def _email(self, at: int, end: int) -> None:
        start = self._left(self.done["email"], at)
        domain = _DOMAIN.match(self.text, end) if start < at else None
        if domain:
            self.base.append((start, domain.end(), "email"))
        self.done["email"] = domain.end() if domain else end

    def _spelled(self, at: int, end: int) -> None:
        near = at - 1 if at and self.text[at - 1] == " " else at
        low = max(self.done["email"], near - 64)
        start = self._left(low, near)
        domain = _SPELLED.match(self.text, end)
        if start == near or not domain or not _TOP.search(domain[0]):
            return
        if start == low and start and self.text[start - 1] in LOCAL:
            return  # longer than a local part may be
        self.more.append((start, domain.end(), "email"))

    def _ip(self, at: int, end: int) -> None:
        low = self.done["ip"]
        if at < low:
            return
        start = low + len(self.text[low : at + 1].rstrip("0123456789"))
        chain = _DOTTED.match(self.text, start)
        self.done["ip"] = chain.end()
        parts = chain[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                self.base.append((start, start + size, "ip"))
            start += size + 1

    def _card(self, at: int, end: int) -> None:
        self._account_at(at)
        if at < self.done["card"]:
            return
        chain = _NUMBER.match(self.text, at)
        self.done["card"] = chain.end()
        if chain.end() - at > 2 * CARD_DIGITS[1]:
            return
        digits = _digits(chain[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            self.base.append((at, chain.end(), "card"))

    def _phone(self, at: int, end: int) -> None:
        run = _DIALLED.match(self.text, end)
        stop = end + len(run[0].rstrip(" ().-")) if run else end
        if stop < at + 4:
            return
        if PHONE_DIGITS[0] <= len(_digits(self.text[at:stop])) <= PHONE_DIGITS[1]:
            self.base.append((at, stop, "phone"))

    def _six(self, at: int, end: int) -> None:
        if at < self.done["six"]:
            return
        low = max(self.done["six"], at - 40)
        start = low + len(self.text[low:at].rstrip("0123456789abcdef:"))
        run = _SIX.match(self.text, start)
        self.done["six"] = run.end()
        self._six_in(start, run.end())

    def _six_in(self, start: int, end: int) -> None:
        value = self.text[start:end].rstrip(".")
        stop = start + len(value)
        bounded = not (start and self.text[start - 1] in _AN) and not (stop < len(self.text) and self.text[stop] in _AN)
        if not bounded or not 6 <= len(value) <= 45 or sum(map(bool, value.split(":"))) < 3:
            return
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return
        self.more.append((start, stop, "ip"))

    def _scheme(self, at: int, end: int) -> None:
        if self.text[at:end] != "://":
            if not (at and self.text[at - 1] in _AN):
                self._number_at(end, "phone")
            return
        authority = _AUTHORITY.match(self.text, end, end + 512)
        if authority["user"]:
            self.more.append((end, end + len(authority["user"]) - 1, "account"))
        if authority["six"]:
            self._six_in(*authority.span("six"))

    def _value_at(self, at: int, end: int) -> int | None:
        """Where the value announced by the word from ``at`` to ``end`` begins."""
        if (at and self.text[at - 1] in _AN) or (end < len(self.text) and self.text[end] in _AN):
            return None
        return _BEHIND.match(self.text, end, end + 64).end()

    def _number_at(self, at: int, kind: str) -> None:
        if self.text[at : at + 1] == "+":
            return  # a base phone number
        number = _LOCAL_PHONE.match(self.text, at, at + 64)
        if number and LOCAL_PHONE_DIGITS[0] <= len(_digits(number[0])) <= LOCAL_PHONE_DIGITS[1] and self._closed(number.end()):
            self.more.append((at, number.end(), kind))

    def _closed(self, end: int) -> bool:
        return end == len(self.text) or self.text[end] not in _AN

    def _call(self, at: int, end: int) -> None:
        if (start := self._value_at(at, end)) is not None:
            self._number_at(start, "phone")

    def _holder(self, at: int, end: int) -> None:
        start = self._value_at(at, end)
        value = _VALUE.match(self.text, start, start + 48) if start is not None else None
        if not value or self._account_at(start):
            return
        # Blanks end a value that is not all digits: the next word is no part of it.
        own = value[0] if not re.search("[a-z]", value[0]) else value[0].split(" ")[0]
        if 6 <= len(_digits(own)) and len(own) <= 24 and self._closed(start + len(own)):
            self.more.append((start, start + len(own), "account"))

    def _insurance(self, at: int, end: int) -> None:
        start = self._value_at(at, end)
        found = _INSURANCE.match(self.text, start) if start is not None else None
        if found and found[1] not in ("000", "666") and found[1] < "900" and found[3] != "00" and found[4] != "0000":
            self.more.append((start, found.end(), "account"))

    def _account_at(self, at: int) -> bool:
        """A bank account number whose check digits or first letter are at ``at``."""
        start = at if self.text[at : at + 1].isalpha() else at - 2
        if start < self.done["iban"] or not self.text[start : start + 2].isalpha() or (start and self.text[start - 1] in _AN):
            return False
        size = IBAN_LENGTHS.get(self.text[start : start + 2])
        run = _IBAN.match(self.text, start, start + 48) if size else None
        if not run:
            return False
        taken, place = [], start
        while len(taken) < size and place < run.end():
            if self.text[place] != " ":
                taken.append(self.text[place])
            place += 1
        if not self._closed(place) or not iban("".join(taken)):
            return False
        self.done["iban"] = place
        self.more.append((start, place, "account"))
        return True


def scan(text: str | None) -> tuple[list, list]:
    """(base spans, all spans) as (start, end, kind number) in code points, sorted."""
    if not text:
        return [], []
    raw = text.encode("utf-8", "surrogatepass")
    work = _Scan(raw.lower().decode("latin-1"))
    work.run()
    if not work.base and not work.more:
        return [], []
    taken: dict[str, list] = {k: sorted((a, b) for a, b, kind in work.base if kind == k) for k in KINDS}
    for a, b, kind in sorted(work.more, key=lambda s: (s[0], -s[1])):
        other = "card" if kind == "account" else kind  # numbers that a base kind has are named once
        if not any(a < d and c < b for c, d in (*taken[kind], *taken[other])):
            taken[kind].append((a, b))
    extra = {(a, b, KINDS.index(k)) for k in KINDS for a, b in taken[k]}
    base = {(a, b, KINDS.index(k)) for a, b, k in work.base}
    if not raw.isascii():
        points, before, count = {}, 0, 0
        for place in sorted({p for a, b, _ in extra for p in (a, b)}):
            count += len(raw[before:place].decode("utf-8", "surrogatepass"))
            points[place], before = count, place
        base, extra = ({(points[a], points[b], k) for a, b, k in spans} for spans in (base, extra))
    order = lambda s: (s[0], s[2], s[1])
    return sorted(base, key=order), sorted(extra, key=order)


def find_private_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``base`` and ``spans``.

    Both are arrays of (start, end, kind) in code points, end exclusive, by start and kind.
    A null or empty text gives empty arrays, repeated rows repeated results, an empty table no
    rows. Only the two columns are read. Whole texts are scanned; a text of any length takes
    time in proportion to it.
    """

    def build():
        def step(ids, texts):
            results = [scan(t) for t in texts]
            named = [[[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in r[i]] for r in results] for i in (0, 1)]
            return ids, *named

        return step

    kind = dict(docs.dtypes)[id_column]
    span = "array<struct<start:bigint,end:bigint,kind:string>>"
    return map_columns(docs, [id_column, text_column], build, f"`{id_column}` {kind}, base {span}, spans {span}")


def mask(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows with every span replaced by its kind in brackets; other columns stay.

    Overlapping spans are replaced as one, by the kind of the first. Null and empty texts stay.
    """

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(_masked)

    return docs.withColumn(text_column, masked(F.col(text_column)))


def _masked(text: str | None) -> str | None:
    out, until = [], 0
    for start, end, kind in scan(text)[1]:
        if start >= until:
            out += [text[until:start], f"[{KINDS[kind]}]"]
        until = max(until, end)
    return "".join(out) + text[until:] if out else text

"""Personal data replaced by format-preserving Feistel pseudonyms.

Card numbers (Luhn), IBANs (mod 97), social security numbers, telephone numbers, IPv4 and IPv6 addresses and calendar dates (of timestamps too)
are found by their form and validated; e-mail addresses, access keys and password or token values by their form. Each
value is read as a number over its variable characters and put through a keyed Feistel network
whose halves are added to, modulo their ranges, so the result is a permutation of the values of that form.
Check digits are computed anew; where a form has a rule (a valid month, no 000 area) the network is walked until the
result obeys it. The value is permuted and then written in the form that it had: separators, the case of letters and the
order of a date are no part of it, so one value has one pseudonym in all documents however it is written. Other text stays.
An address of single digits (1.2.3.4) is read as the number of a section or version, and a word behind `token:` as prose
unless it has a digit or capitals inside, is quoted, or stands behind `=`.

Defined results: a null text stays null; empty texts and texts without such data are unchanged; numbers that fail their
check are left alone unless they are valid as another kind, and what they hold is tried from each group of digits on; of
neighbours that pass a card's check together by chance the likelier reading is taken; repeated rows get equal results; whole texts are read at any length; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.shared import free_name, slices, table

ROUNDS = 8
KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ip", "date")
#: What the registered query uses where the session names no key in trustlake.pii.key. It is public, so it protects nothing: the
#: operator itself has no default.
TEST_KEY = "public key of the test tables"

_MONTHS = "January February March April May June July August September October November December".split()
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def feistel(key: bytes, tweak: str, value: int, left: int, right: int) -> int:
    """A keyed permutation of range(left * right)."""
    a, b = divmod(value, right)
    for r in range(0, ROUNDS, 2):
        a = (a + _keyed(key, tweak, r, b)) % left
        b = (b + _keyed(key, tweak, r + 1, a)) % right
    return a * right + b


def _keyed(key: bytes, tweak: str, turn: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{turn}|{value}".encode(), key=key, digest_size=32).digest(), "big")


def _radix(c: str) -> int:
    return 10 if c.isdigit() else 26


def permuted(key: bytes, tweak: str, text: str, ranges: dict[int, tuple[int, int]] | None = None, valid: Callable[[str], bool] = lambda t: True) -> str:
    """text with its ASCII letters and digits permuted within their kinds; ranges: (lowest, number) for places of digits that have fewer
    choices; the network is walked until valid(result). (text itself is valid, so the walk ends.)"""
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    low = {i: (ranges or {}).get(i, (0, _radix(text[i]))) for i in at}
    # what a value is: its letters and digits, whatever stands between them and whatever the letters' case
    kinds = "".join("9" if text[i].isdigit() else "a" for i in at) + f"|{[k for k, i in enumerate(at) if i in (ranges or {})]}"
    if not at:
        return text
    half = len(at) // 2
    left = right = 1
    for k, i in enumerate(at):
        left, right = (left * low[i][1], right) if k < half else (left, right * low[i][1])
    value = 0
    for i in at:
        c = text[i]
        value = value * low[i][1] + (int(c) - low[i][0] if c.isdigit() else ord(c.lower()) - 97)
    while True:
        value = feistel(key, f"{tweak}|{kinds}", value, left, right)
        out, rest = list(text), value
        for i in reversed(at):
            rest, digit = divmod(rest, low[i][1])
            out[i] = str(digit + low[i][0]) if text[i].isdigit() else chr(97 + digit).upper() if text[i].isupper() else chr(97 + digit)
        if valid(result := "".join(out)):
            return result


def luhn_digit(digits: str) -> str:
    """The check digit behind digits."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _card(key: bytes, t: str) -> str | None:
    digits = re.sub(r"\D", "", t)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    new = permuted(key, "card", digits[:-1], {0: (1, 9)} if digits[0] != "0" else {0: (0, 1)})
    return _refill(t, new + luhn_digit(new))


def _refill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _ssn_valid(t: str) -> bool:
    return t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000"


def _ssn(key: bytes, t: str) -> str | None:
    return permuted(key, "ssn", t, valid=_ssn_valid) if _ssn_valid(t) else None


def _phone(key: bytes, t: str) -> str | None:
    places = [i for i, c in enumerate(t) if c.isdigit()]
    if not 9 <= len(places) <= 15:
        return None
    kept = 0
    if t.startswith("+"):  # the country's digits stay: up to the first gap, or one for a long run
        lead = re.match(r"\+(\d{1,3})(?=\D)", t)
        kept = len(lead[1]) if lead else 1
    elif len(places) != 10:
        return None
    own = places[kept:]
    ranges = {i: (2, 8) for i in (own[0], own[3]) if len(own) == 10 and t[i] in "23456789"}
    cut = own[0]
    return t[:cut] + permuted(key, "phone", t[cut:], {i - cut: r for i, r in ranges.items()})


def _ip(key: bytes, t: str) -> str | None:
    parts = t.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts) or all(len(p) == 1 for p in parts):
        return None
    value = feistel(key, "ip", sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)), 1 << 16, 1 << 16)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ip6(key: bytes, t: str) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(t))
    except ValueError:
        return None
    if len([g for g in t.split(":") if g]) < 3:  # two short words with :: between them
        return None
    new = ipaddress.IPv6Address(feistel(key, "ip6", value, 1 << 64, 1 << 64))
    out = new.exploded if len(t) == 39 else new.compressed
    return out.upper() if t == t.upper() else out


def _iban(key: bytes, t: str) -> str | None:
    plain = t.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    new = permuted(key, f"iban{plain[:2]}", plain[4:])
    it = iter(plain[:2] + _iban_check(plain[:2], new) + new)
    return "".join(c if c == " " else next(it) for c in t)


_DATES = [
    (re.compile(r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})$"), "{y:04d}{s}{m:02d}{s}{d:02d}"),
    (re.compile(r"(?P<m>0[1-9]|1[0-2])(?P<s>[-/.])(?P<d>\d{2})(?P=s)(?P<y>\d{4})$"), "{m:02d}{s}{d:02d}{s}{y:04d}"),
    (re.compile(r"(?P<d>\d{2})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<y>\d{4})$"), "{d:02d}{s}{m:02d}{s}{y:04d}"),
    (re.compile(r"(?P<m>0?[1-9]|1[0-2])(?P<s>[-/.])(?P<d>\d{1,2})(?P=s)(?P<y>\d{4})$"), "{m}{s}{d}{s}{y:04d}"),
    (re.compile(rf"(?P<n>{'|'.join(_MONTHS)})(?P<s> )(?P<d>\d{{1,2}}), (?P<y>\d{{4}})$"), "{n} {d}, {y:04d}"),
    (re.compile(rf"(?P<d>\d{{1,2}})(?P<s> )(?P<n>{'|'.join(_MONTHS)}) (?P<y>\d{{4}})$"), "{d} {n} {y:04d}"),
    (re.compile(r"(?P<d>\d{1,2})(?P<s>[-/.])(?P<m>0?[1-9]|1[0-2])(?P=s)(?P<y>\d{4})$"), "{d}{s}{m}{s}{y:04d}"),
    (re.compile(r"(?P<y>\d{4})(?P<s>[-/])(?P<m>0?[1-9]|1[0-2])(?P=s)(?P<d>\d{1,2})$"), "{y:04d}{s}{m}{s}{d}"),
]


def _read_date(t: str) -> tuple[int, int, str] | None:
    """(form, days since 1900, separator) of a valid date of the years 1900 to 2099."""
    for form, (pattern, _) in enumerate(_DATES):
        if m := pattern.match(t):
            g = m.groupdict()
            try:
                day = datetime.date(int(g["y"]), int(g["m"]) if g.get("m") else _MONTHS.index(g["n"]) + 1, int(g["d"])).toordinal() - _FIRST_DAY
            except ValueError:
                continue
            if 0 <= day < _DAYS:
                return form, day, g["s"]
    return None


def _date(key: bytes, t: str) -> str | None:
    """Another date in the same form. Days up to 12 stay among themselves, as do later ones, so that the result is read as it is
    meant: 25/03/2001 is read by its day, 03/04/2001 month first."""
    if (got := _read_date(t)) is None:
        return None
    form, day, mark = got
    old = datetime.date.fromordinal(day + _FIRST_DAY)
    side = int(_DAYS**0.5) + 1
    while True:
        day = feistel(key, "date", day, side, side)
        if day < _DAYS:
            d = datetime.date.fromordinal(day + _FIRST_DAY)
            if (d.day > 12) == (old.day > 12):
                return _DATES[form][1].format(y=d.year, m=d.month, d=d.day, n=_MONTHS[d.month - 1], s=mark)


def _email(key: bytes, t: str) -> str | None:
    local, _, domain = t.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{permuted(key, 'email', local)}@{permuted(key, 'host', host)}.{top}"


def _secret(key: bytes, t: str) -> str | None:
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", t)
    if not hexadecimal:
        return permuted(key, "secret", t)
    half = len(t) // 2
    value = feistel(key, f"hex{len(t)}", int(t, 16), 16**half, 16 ** (len(t) - half))
    return f"{value:0{len(t)}x}" if t == t.lower() else f"{value:0{len(t)}X}"


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SECRETS = re.compile(r"(?<![A-Za-z0-9])(AKIA)([0-9A-Z]{12,})(?![A-Za-z0-9])|(?i:(\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?))([A-Za-z0-9+/_-]{6,})")
_CODED = re.compile(r"\d|[a-z][A-Z]|[A-Z]{2}.*[a-z]")


def _emails(part: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the e-mail addresses: from each @ back over what may stand before it, and on over the domain."""
    done, at = 0, part.find("@")
    while at >= 0:
        start = at
        while start > done and part[start - 1] in _LOCAL:
            start -= 1
        while start < at and not part[start].isalnum():
            start += 1
        done = at + 1
        if start < at and (domain := _DOMAIN.match(part, at + 1)):
            done = domain.end()
            yield start, done
        at = part.find("@", done)


_FORMS = {
    "iban": r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)",
    "ip6": r"(?P<ip6>(?<!:)(?:[0-9A-Fa-f]{1,4}:){1,7}(?:[0-9A-Fa-f]{1,4}|:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}))(?![\w:])",
    "date": rf"(?P<date>\d{{4}}(?:(?P<ymd>[-/.])\d{{2}}(?P=ymd)\d{{2}}|(?P<y1>[-/])\d{{1,2}}(?P=y1)\d{{1,2}})|\d{{1,2}}(?P<dmy>[-/.])\d{{1,2}}(?P=dmy)\d{{4}}|(?:{'|'.join(_MONTHS)}) \d{{1,2}}, \d{{4}}|\d{{1,2}} (?:{'|'.join(_MONTHS)}) \d{{4}})(?!(?!T\d\d:)\w|[-/]\d)",
    "ssn": r"(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w]|-\d)",
    "card": r"(?P<card>\d(?:[ -]?\d){12,18})(?![\w]|-\d)",
    "phone": r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]|-\d)",
}
_BEFORE = r"(?<![\w@])(?<!\d\.)"
_NUMBERS = re.compile(f"{_BEFORE}(?:{'|'.join(_FORMS.values())})")
_EACH = {kind: re.compile(_BEFORE + form) for kind, form in _FORMS.items()}
#: How cards are written, the likelier first: lengths of their groups.
_LAYOUTS = [(4, 4, 4, 4), (4, 6, 5), *[(n,) for n in range(13, 20)], (4, 4, 4, 4, 3), (4, 6, 4), (4, 4, 5), (4, 3, 3, 3)]
_RULES: dict[str, Callable[[bytes, str], str | None]] = {"iban": _iban, "ip": _ip, "ip6": _ip6, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
_DIGIT = re.compile(r"\d{2}")


def _layout(t: str) -> int:
    """The place in _LAYOUTS of a number with one kind of separator; behind them other groups or first digits than
    payment cards have, and then mixed separators."""
    groups = tuple(map(len, re.split(r"[ -]", t)))
    if " " in t and "-" in t:
        return len(_LAYOUTS) + 1
    return _LAYOUTS.index(groups) if groups in _LAYOUTS and re.match(r"2[2-7]|[3-6]", t) else len(_LAYOUTS)


def _valid(key: bytes, part: str, start: int, kind: str, layouts: int = 99) -> tuple[int, str, str] | None:
    """(end, kind, pseudonym) of the valid value of a kind that starts at start; its last groups may belong to a neighbour."""
    if (m := _EACH[kind].match(part, start)) is None:
        return None
    ends = [m.end()]
    if kind in ("card", "iban"):
        ends += [start + g.start() for g in reversed(list(re.finditer(r"[ -]", m[0]))) if _EACH[kind].fullmatch(part, start, start + g.start())]
    if kind == "card":
        ends = sorted((e for e in ends if _layout(part[start:e]) <= layouts), key=lambda e: _layout(part[start:e]))
    for end in ends:
        if (new := _RULES[kind](key, part[start:end])) is not None and not (kind == "card" and layouts == 99 and _joined(key, part, start, end)):
            return end, kind, new
    return None


def _joined(key: bytes, part: str, start: int, end: int) -> bool:
    """Whether a card of unusual groups is neighbours that pass its check by chance, as a likelier value starts among them."""
    t = part[start:end]
    if (layout := _layout(t)) < len(_LAYOUTS):
        return False
    others = [k for k in _EACH if k != "card"] if layout > len(_LAYOUTS) else []
    for s in [start, *(start + g.end() for g in re.finditer(r"[ -]", t))]:
        if any(_valid(key, part, s, k) for k in others) or (s > start and _valid(key, part, s, "card", len(_LAYOUTS) - 1)):
            return True
    return False


def _values(key: bytes, part: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values among a text's numbers. Where none is valid at a place, the next group of digits is tried."""
    at = 0
    while m := _NUMBERS.search(part, at):
        kind, at = m.lastgroup, m.start() + 1
        new = _RULES[kind](key, m[0]) if kind != "card" else None
        got = (m.end(), kind, new) if new is not None else next(filter(None, (_valid(key, part, m.start(), k) for k in _EACH)), None)
        if got:
            yield m.start(), *got
            at = got[0]


_KEYWORD = re.compile(r"AKIA|pass|pwd|secret|token|key", re.IGNORECASE)


def pseudonymize(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """(text with pseudonyms, how many values of each kind were replaced)."""
    found: dict[str, int] = {}

    def put(kind: str, old: str, new: str | None) -> str:
        if new is None:
            return old
        kind = "ip" if kind == "ip6" else kind
        found[kind] = found.get(kind, 0) + 1
        return new

    def places(part: str, pattern: re.Pattern, rule: Callable[[re.Match], str]) -> Iterator[tuple[int, int, str]]:
        if pattern is _NUMBERS:
            return ((start, end, put(kind, part[start:end], new)) for start, end, kind, new in _values(key, part))
        if pattern is _DOMAIN:
            return ((start, end, put("email", part[start:end], _email(key, part[start:end]))) for start, end in _emails(part))
        return ((m.start(), m.end(), rule(m)) for m in pattern.finditer(part))

    def secret(m: re.Match) -> str:
        if m[4] and not ("=" in m[3] or m[3][-1] in "\"'" or _CODED.search(m[4])):
            return m[0]
        return (m[1] or m[3]) + put("secret", m[2] or m[4], _secret(key, m[2] or m[4]))

    if text:
        emails = "@" in text
        keywords = _KEYWORD.search(text) is not None
        if emails or keywords or _DIGIT.search(text):
            # found stretches are kept apart, so that no rule reads another's pseudonym
            parts = [text]
            for rule, pattern in ((None, _DOMAIN if emails else None), (secret, _SECRETS if keywords else None), (None, _NUMBERS)):
                if pattern is None:
                    continue
                cut = []
                for i, part in enumerate(parts):
                    if i % 2:
                        cut.append(part)
                        continue
                    done = 0
                    for start, end, new in places(part, pattern, rule):
                        if new != part[start:end]:
                            cut += [part[done:start], new]
                            done = end
                    cut.append(part[done:])
                parts = cut
            text = "".join(parts)
    return text, found


def pseudonyms(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col replaced and a column pii of counts by kind (map<string,int>, empty without values).

    Whoever knows the key can undo the pseudonyms; an empty key raises ValueError."""
    if not key:
        raise ValueError("pseudonyms need a key")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.arrow_udf("struct<text:string,found:map<string,int>>")
    def replaced(texts: pa.Array) -> pa.Array:
        pairs = [pseudonymize(t, secret) for some in slices(texts) for t in some.to_pylist()]
        found = pa.array([sorted(f.items()) for _, f in pairs], pa.map_(pa.string(), pa.int32()))
        return pa.StructArray.from_arrays([pa.array([t for t, _ in pairs], pa.string()), found], ["text", "found"])

    out, name = free_name(docs, "replaced_"), free_name(docs, "pii")
    marked = docs.withColumn(out, replaced(F.col(text_col).cast("string")))
    return marked.withColumn(text_col, F.col(f"{out}.text")).withColumn(name, F.col(f"{out}.found")).drop(out)


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("trustlake.pii.key", TEST_KEY)
    found = pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    counts = [F.coalesce(F.element_at("pii", k), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", "text", *counts)

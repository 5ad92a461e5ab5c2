"""Format-preserving pseudonyms: a keyed Feistel permutation of validated values within their format.

A value is read as a number below the size of its format (the digits of a card without the check
digit, the place of a date among the days of two centuries, the letters of a mail name), permuted
by a Feistel network and written back in the same form, with new check digits. One value has
one pseudonym in all documents, however it is spaced or capitalised, and two values never share
one. ``reverse`` undoes it for who has the key. Rows are changed where they lie.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import query, table, with_columns

ROUNDS = 10
KEY = "example key, set your own"


def feistel(x: int, size: int, key: bytes, tweak: str, reverse: bool = False) -> int:
    """A permutation of the numbers below ``size``: halves of equal width, and again while the result is too large."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    start = key + tweak.encode() + b"\0" + size.to_bytes((size.bit_length() + 7) // 8) + b"\0"

    def mix(r: int, part: int) -> int:
        return int.from_bytes(hashlib.shake_256(start + bytes([r]) + part.to_bytes(width)).digest(width)) & mask

    while True:
        a, b = x >> half, x & mask
        if reverse:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ mix(r, a), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ mix(r, b)
        x = a << half | b
        if x < size:
            return x


# ---------------------------------------------------------------- formats

Change = Callable[[int, int, str], int]  # number, size, format -> number


def spell(template: str, chars: list[str]) -> str:
    """``template`` with its ASCII letters and digits replaced in turn, in the case that it has."""
    turn = iter(chars)
    return "".join((c.upper() if old.isupper() else c) if re.match("[A-Za-z0-9]", old) and (c := next(turn, None)) is not None else old for old in template)


def digits_of(text: str) -> str:
    return re.sub(r"\D", "", text)


def permuted_digits(digits: str, kind: str, change: Change) -> str:
    return str(change(int(digits), 10 ** len(digits), f"{kind}{len(digits)}")).zfill(len(digits)) if digits else ""


def permuted_mixed(text: str, kind: str, change: Change) -> str:
    """Letters stay letters and digits stay digits; marks stay."""
    plain = re.findall("[A-Za-z0-9]", text)
    bases = [10 if c.isdigit() else 26 for c in plain]
    x, size = 0, 1
    for c, base in zip(plain, bases, strict=True):
        x, size = x * base + (int(c) if base == 10 else ord(c.lower()) - 97), size * base
    if size == 1:
        return text
    x, out = change(x, size, kind + "".join("9" if b == 10 else "a" for b in bases)), []
    for base in reversed(bases):
        x, low = divmod(x, base)
        out.append(str(low) if base == 10 else chr(97 + low))
    return spell(text, out[::-1])


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    doubled = (sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -sum(doubled) % 10


def card(text: str, change: Change) -> str | None:
    """13 to 19 digits with a right check digit; the first digit stays, the check digit is made anew."""
    d = digits_of(text)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    body = d[0] + permuted_digits(d[1:-1], "card", change)
    return spell(text, list(body + str(luhn(body))))


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban(text: str, change: Change) -> str | None:
    """An account number with right check digits; the country stays, the check digits are made anew."""
    plain = text.replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or mod97(plain) != 1 or not 2 <= int(plain[2:4]) <= 98:
        return None
    body = permuted_mixed(plain[4:], f"iban{plain[:2]}", change)
    return spell(text, list(plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body))


def phone(text: str, change: Change) -> str | None:
    """7 to 15 digits; a country code stays."""
    code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    head = code.group() if code else "+" * text.startswith("+")
    d = digits_of(text[len(head) :])
    if not 7 <= len(digits_of(text)) <= 15:
        return None
    return head + spell(text[len(head) :], list(permuted_digits(d, f"phone{head}", change)))


def social(text: str, change: Change) -> str | None:
    """A social security number in use: first part 001 to 899 without 666, the others not zero."""
    a, b, c = (int(x) for x in re.split("[- ]", text))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    x = change(((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, "social")
    x, c = divmod(x, 9999)
    a, b = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}{text[3]}{b + 1:02d}{text[6]}{c + 1:04d}"


def address(text: str, change: Change) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, change(int.from_bytes(bytes(parts)), 1 << 32, "address").to_bytes(4)))


def mail(text: str, change: Change) -> str:
    """The name is permuted, the domain stays; capitals make no difference."""
    name, _, domain = text.rpartition("@")
    return f"{permuted_mixed(name, 'mail' + domain.lower(), change)}@{domain}"


def secret(text: str, change: Change) -> str:
    """The value after a word like token and a sign; a hexadecimal one stays hexadecimal."""
    head, value = re.fullmatch(r"(.*[=:]\s*[\"']?)(.*)", text, re.S).groups()
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        new = format(change(int(value, 16), 16 ** len(value), f"hex{len(value)}"), f"0{len(value)}x")
        return head + (new.upper() if re.search("[A-F]", value) else new)
    return head + permuted_mixed(value, "secret", change)


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LATE = [n for n in range(FIRST, LAST + 1) if datetime.date.fromordinal(n).day > 12]
LATE_AT = {n: i for i, n in enumerate(LATE)}


def date(text: str, change: Change) -> str | None:
    """A day from 1900 to 2099 as y-m-d, d.m.y, m/d/y or, where that is no date, d/m/y.

    The last form has days after the 12th only, which are permuted among themselves.
    """
    a, b, c = (int(x) for x in re.split(r"[-./]", text))
    mark = re.search(r"[-./]", text).group()
    forms = {"-": [(a, b, c)], ".": [(c, b, a)], "/": [(c, a, b), (c, b, a)]}[mark]
    for swapped, (y, m, d) in enumerate(forms):
        try:
            n = datetime.date(y, m, d).toordinal()
        except ValueError:
            continue
        if not FIRST <= n <= LAST:
            return None
        if swapped:
            n = LATE[change(LATE_AT[n], len(LATE), "late date")]
        else:
            n = FIRST + change(n - FIRST, LAST - FIRST + 1, "date")
        new = datetime.date.fromordinal(n)
        order = {"-": (new.year, new.month, new.day), ".": (new.day, new.month, new.year), "/": (new.day, new.month, new.year) if swapped else (new.month, new.day, new.year)}[mark]
        return mark.join(f"{x:04d}" if x > 31 else f"{x:02d}" for x in order)
    return None


KINDS: dict[str, tuple[str, Callable]] = {
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])", mail),
    "secret": (r"\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}", secret),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    "card": (r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])", card),
    "date": (r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)", date),
    "social": (r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])", social),
    "address": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", address),
    "phone": (r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-])", phone),
}
PATTERNS = [(name, re.compile(pattern, re.ASCII), change) for name, (pattern, change) in KINDS.items()]
ANY = re.compile("[0-9@]|[=:]")


# Characters of an IBAN of each country.
IBAN_LENGTH = {
    n: int(k)
    for k, names in (part.split(":") for part in (
        "15:NO|16:BE|18:DK FI FO GL NL SD FK|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH CR HR LI LV|22:BG BH DE GB GE IE ME RS VA|23:AE GI IL IQ OM SO TL"
        "|24:AD CZ DZ ES MD MR PK RO SA SE SK TN VG|25:LY PT ST|26:IS TR|27:BI DJ FR GR IT MC SM|28:AL AZ BY CY DO GT HN HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU"
    ).split("|"))
    for n in names.split()
}
GROUP = re.compile(r"[+(]*[A-Za-z0-9]+\)?")


def inner(name: str, pattern: re.Pattern, text: str) -> tuple[list[tuple[int, int]], int]:
    """Spans of whole groups in a failed match that have the pattern's form, in the order to try them, and the end of the first group.

    The longest come first, of IBANs those with the length of their country.
    """
    groups = [g.span() for g in GROUP.finditer(text)]
    found = [(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if b - a < len(text) and pattern.fullmatch(text[a:b])]

    def rank(span):
        plain = re.sub("[^A-Za-z0-9]", "", text[slice(*span)])
        return name == "iban" and IBAN_LENGTH.get(plain[:2]) != len(plain), -len(plain), span

    return sorted(found, key=rank), groups[0][1]


def replaced(name: str, pattern: re.Pattern, make: Callable, text: str, change: Change) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of the values of one kind. A failed match may hold a valid value beside other groups, or overlap the next one."""
    out, at = [], 0
    while m := pattern.search(text, at):
        new, first = make(m.group(), change), 0
        best = (0, len(m.group()), new) if new is not None else None
        if best is None:
            spans, first = inner(name, pattern, m.group())
            made = ((a, b, make(m.group()[a:b], change)) for a, b in spans)
            best = next((x for x in made if x[2] is not None), None)
        if best:
            out.append((m.start() + best[0], m.start() + best[1], best[2]))
            at = out[-1][1]
        else:
            at = m.start() + first
    return out


def pseudonymise(text: str, key: str, reverse: bool = False) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds replaced. Kinds are tried in order; what one replaced no other touches."""
    if not ANY.search(text):
        return text, []
    keyed = key.encode() + b"\0"

    def change(x: int, size: int, form: str) -> int:
        return feistel(x, size, keyed, form, reverse)

    parts, kinds = [(text, False)], []
    for name, pattern, make in PATTERNS:
        done = []
        for part, fixed in parts:
            if fixed or not part:
                done.append((part, fixed))
                continue
            at = 0
            for start, end, new in replaced(name, pattern, make, part, change):
                done += [(part[at:start], False), (new, True)]
                at = end
                kinds.append(name)
            done.append((part[at:], False))
        parts = done
    return "".join(p for p, _ in parts), kinds


def with_pseudonyms(docs: DataFrame, key: str, text: str = "text", reverse: bool = False, found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, all columns in their order; ``found`` names a column for the kinds replaced.

    Null and empty texts stay as they are, rows are independent of each other, so equal rows stay
    equal. A number that fails its check digits, or a date that is none, is no personal value
    and stays, but valid values among its groups are replaced. ``reverse`` reads such a value wrongly
    where its pseudonym and the groups beside it happen to pass the check together: of cards one in ten
    for each longer span, of IBANs one in a hundred.
    """

    def run(column):
        made = [pseudonymise(t, key, reverse) if t else (t, []) for t in column.to_pylist()]
        out = {text: pa.array([t for t, _ in made], pa.string())}
        return out | ({found: pa.array([k for _, k in made], pa.list_(pa.string()))} if found else {})

    names = {text: "string"} | ({found: "array<string>"} if found else {})
    done = with_columns(docs, F.col(f"`{text}`").cast("string"), run, names)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns if c != found], *([found] if found else []))


@query("op1_feistel_pseudonyms")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY, found="kinds")
    return done.withColumn("n_values", F.size("kinds").cast("long"))

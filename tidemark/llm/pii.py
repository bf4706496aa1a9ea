"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A scan finds candidates; a validator per kind (Luhn sum, mod 97, octet range, groups,
calendar, issued number ranges) decides which are real; a keyed Feistel network then
permutes each value within its own format.  What is permuted is the value without its
separators, which are laid back afterwards; so equal values get equal pseudonyms in
every document and every spelling, and different values never meet.

* ``email``: the local part, each ASCII letter or digit within its class (other
  letters stay);
* ``phone``: all digits but the country code (ten digits in US groups, with or without
  it; any number of 8 to 15 digits after ``+``); area codes are not looked up;
* ``card``: all digits but the last, which becomes the Luhn digit again;
* ``iban``: all letters and digits after the country and the check digits, which are
  made anew;
* ``ssn`` and ``secret``: all letters and digits within their class (a secret
  of hexadecimal digits within these);
* ``ip``: a permutation of the 2^32 addresses; an IPv6 address keeps no digit and is
  written in eight whole groups;
* ``date`` (ISO, or slashes or dots with a four-digit year, 1900-01-01 up to
  2099-08-04): a permutation of these 72,900 days, written in the same pattern.

All of it is DataFrame expressions.  A null text stays null with counts of 0; a
text without validated values stays as it is; numbers that fail their check are
left alone.  Extra columns pass through (those of the counts' names are replaced),
repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, unboxed

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")

_SECRET = (r"(?<![A-Za-z0-9_\-])(?=[A-Za-z0-9_\-]{16})"
           r"(?<=(?i:token|key|secret|password|passwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-]{16,}+")
#: A local part is the whole run of its characters, or what an address before it left of the run.
_EMAIL = (r"(?:\G|(?<![\p{L}0-9._%+\-]))[\p{L}0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}+")
_PHONE = (r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])")
_IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
_DATE = (r"(?<![0-9A-Za-z/.\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
         r"(?![0-9A-Za-z])")
_SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
_CARD = (r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9A-Za-z])")
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
_ABROAD = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .\-/]?(?:\([0-9]{1,5}\)|[0-9]{1,12})){1,6}(?![0-9])"
_IPV6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{5})(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])"
#: Only the card pattern has a group of its own, so its reference is the first.
PATTERN = "|".join((_SECRET, _EMAIL, _PHONE, _ABROAD, _IP, _DATE, _SSN, _CARD, _IBAN, _IPV6))

#: Country codes of one and of two digits; all others have three.
_COUNTRY = ("1 7", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
            "81 82 84 86 90 91 92 93 94 95 98")
_ABROAD_CODE = rf"^\+(?:{'|'.join(' '.join(_COUNTRY).split())}|[0-9]{{3}})"

_ROUNDS = 8
_DAYS_SIDE = 270
_EPOCH = "1900-01-01"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum of a digit string, read from its right end."""
    first = 0 if doubled_first else 1

    def weigh(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == first, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda s, d: s + d)


def _number(digest: Column, modulus: int) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % modulus


def _pair_permutation(x: Column, side: int, key: str, kind: str) -> Column:
    """Feistel network on the numbers below side * side."""
    start = F.struct((F.floor(x / side)).cast("long").alias("l"), (x % side).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), s["r"].cast("string")), 256)
        return F.struct(s["r"].alias("l"), ((s["l"] + _number(digest, side)) % side).alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(_ROUNDS))), start, step, lambda s: s["l"] * side + s["r"])


def _shift(text: Column, digest: Column, kind: str) -> Column:
    """Move each letter or digit of ``text`` within its class by bytes of the digest."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, (2 * i) % 128 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        if kind == "hex":
            moved = F.hex((F.conv(c, 16, 10).cast("long") + by) % 16)
            return F.lower(moved)
        return (F.when(c.between("0", "9"), F.char((code - 48 + by) % 10 + 48))
                .when(c.between("a", "z"), F.char((code - 97 + by) % 26 + 97))
                .when(c.between("A", "Z"), F.char((code - 65 + by) % 26 + 65)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _cycle(letters: str, key: str, kind: str) -> str:
    """The letters, each replaced by the next one of a keyed cycle: none stays itself."""
    order = sorted(letters, key=lambda c: hashlib.sha256(f"{key}|{kind}|{c}".encode()).hexdigest())
    return "".join(order[(order.index(c) + 1) % len(order)] for c in letters)


def _text_permutation(x: Column, key: str, kind: str) -> Column:
    """Feistel network over the two halves of a string; its pattern stays.  A single character has a permutation of its own."""
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1).alias("r"))

    def step(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), s["r"]), 512)
        return F.struct(s["r"].alias("l"), _shift(s["l"], digest, kind).alias("r"))

    classes = ("0123456789abcdef",) if kind == "hex" else (string.digits, string.ascii_lowercase, string.ascii_uppercase)
    alone = F.translate(x, "".join(classes), "".join(_cycle(c, key, kind) for c in classes))
    mixed = F.aggregate(F.array(*map(F.lit, range(_ROUNDS))), start, step, lambda s: F.concat(s["l"], s["r"]))
    return F.when(F.length(x) == 1, alone).otherwise(mixed)


def _lay(x: Column, new: Column, place: str) -> Column:
    """``x`` with its characters of the class ``place`` replaced by those of ``new`` in turn."""
    nth = lambda i: F.length(F.regexp_replace(F.substr(x, F.lit(1), i + 1), f"[^{place}]", ""))
    put = lambda c, i: F.when(c.rlike(f"[{place}]"), F.substr(new, nth(i), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(x, ""), put), "")


def _mod97(x: Column) -> Column:
    """Letters and digits as the number that IBANs stand for, modulo 97."""
    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(x, ""), F.lit(0), step)


def _ipv6_digits(x: Column) -> Column:
    """The 32 digits of an IPv6 address; null if it is none."""
    sides = F.split(F.lower(x), "::", -1)
    groups = lambda s: F.filter(F.split(s, ":", -1), lambda g: g != "")
    head, tail = groups(F.get(sides, F.lit(0))), F.when(F.size(sides) == 2, groups(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    n = F.size(head) + F.size(tail)
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
    whole = F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), "")
    # Short forms of a group or two are rather paths of names than addresses of someone.
    ok = ((F.size(sides) == 1) & (n == 8)) | ((F.size(sides) == 2) & n.between(3, 7))
    return F.when(ok & ~x.rlike(r":::|^:[^:]|[^:]:$"), whole)


def _as_date(x: Column) -> Column:
    return F.coalesce(
        F.when(x.contains("-"), F.try_to_date(x, "yyyy-MM-dd")),
        F.when(x.contains("/"), F.coalesce(F.try_to_date(x, "MM/dd/yyyy"), F.try_to_date(x, "dd/MM/yyyy"))),
        F.when(x.contains("."), F.try_to_date(x, "dd.MM.yyyy")),
    )


def kind_of(x: Column) -> Column:
    """The kind of a candidate, null where its check fails."""
    octets = F.split(x, r"\.")
    days = F.datediff(_as_date(x), F.lit(_EPOCH).cast("date"))
    digits, bare = _digits(x), F.replace(x, F.lit(" "), F.lit(""))
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ip")))
        .when(x.rlike(f"^(?:{_DATE})$"), F.when(days.between(0, _DAYS_SIDE * _DAYS_SIDE - 1), F.lit("date")))
        .when(x.rlike(f"^(?:{_SSN})$"),
              F.when(~x.rlike(r"^(?:000|666|9)|^...-00|0000$"), F.lit("ssn")))
        .when(x.rlike(f"^(?:{_PHONE})$"), "phone")
        .when(x.startswith("+"), F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .when(x.rlike(f"^(?:{_CARD})$"), F.when(_luhn_sum(digits, False) % 10 == 0, F.lit("card")))
        .when(x.rlike(f"^(?:{_IBAN})$"), F.when(_mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1, F.lit("iban")))
        .when(x.contains(":") & x.rlike(f"^(?:{_IPV6})$"), F.when(_ipv6_digits(x).isNotNull(), F.lit("ip")))
        .when(x.rlike(r"[0-9]"), "secret")
    )


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a known kind; other values stay."""
    local = F.substring_index(x, "@", 1)
    email = F.concat(_text_permutation(local, key, "email"), F.substr(x, F.length(local) + 1))
    abroad = ~x.rlike(f"^(?:{_PHONE})$")
    country = F.when(abroad, F.regexp_extract(x, _ABROAD_CODE, 0)).otherwise(
        F.regexp_extract(x, r"^\+[0-9]{1,3}(?=[ .\-]?(?:\([0-9]{3}\)|[0-9]{3}[.\-]))", 0))
    rest = F.substr(x, F.length(country) + 1)
    phone = F.concat(country, _lay(rest, _text_permutation(_digits(rest), key, "phone"), "0-9"))
    digits = _digits(x)
    body = _text_permutation(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = _lay(x, F.concat(body, ((10 - _luhn_sum(body, True) % 10) % 10).cast("string")), "0-9")
    bare = F.replace(x, F.lit(" "), F.lit(""))
    account = _text_permutation(F.substr(bare, F.lit(5)), key, "iban")
    land = F.substr(bare, F.lit(1), F.lit(2))
    proof = F.lpad((98 - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")
    iban = _lay(x, F.concat(land, proof, account), "0-9A-Z")
    moved = _text_permutation(_ipv6_digits(x), key, "hex")
    ipv6 = F.concat_ws(":", *(F.substring(moved, 4 * i + 1, 4) for i in range(8)))
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    address = _pair_permutation(F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o), 65536, key, "ip")
    ip = F.concat_ws(".", *((F.shiftright(address, 8 * i) % 256).cast("string") for i in (3, 2, 1, 0)))
    day = F.date_add(F.lit(_EPOCH).cast("date"), _pair_permutation(
        F.datediff(_as_date(x), F.lit(_EPOCH).cast("date")).cast("long"), _DAYS_SIDE, key, "date").cast("int"))
    date = (F.when(x.contains("-"), F.date_format(day, "yyyy-MM-dd"))
            .when(x.contains("."), F.date_format(day, "dd.MM.yyyy"))
            .when(F.try_to_date(x, "MM/dd/yyyy").isNotNull(), F.date_format(day, "MM/dd/yyyy"))
            .otherwise(F.date_format(day, "dd/MM/yyyy")))
    lower = _text_permutation(F.lower(x), key, "hex")
    hexadecimal = F.when(x == F.lower(x), lower).otherwise(F.upper(lower))
    return (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card)
            .when(kind == "iban", iban).when((kind == "ip") & x.contains(":"), ipv6).when(kind == "ip", ip).when(kind == "date", date)
            .when((kind == "secret") & (x.rlike("^[0-9a-f]+$") | x.rlike("^[0-9A-F]+$")), hexadecimal)
            .when(kind.isin("ssn", "secret"), _text_permutation(x, key, "text")).otherwise(x))


def _is(kind: str):
    return lambda m: m["k"] == kind


def pseudonymize(docs: DataFrame, *, key: str, text: str = "text", counts: bool = True, length: str | None = None) -> DataFrame:
    """Replace the validated values of ``text``; add ``n_<kind>`` and ``n_private`` if ``counts``.

    ``length`` names a column that holds the length of the text and follows it.
    """
    t = F.col("_text")
    # Every kind has a digit or an at sign, and most texts have neither.
    some = t.rlike("[0-9@]")
    found = boxed(docs, _text=F.col(text)).withColumn("_found", F.when(some, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
                                                      .otherwise(F.array().cast("array<string>")))
    kinds = F.transform("_found", lambda x: F.struct(x.alias("x"), kind_of(x).alias("k")))
    named = found.withColumn("_kinds", F.when(F.size("_found") > 0, kinds)).drop("_found")
    # The values stand between the pieces, so both are joined in turn.
    changed = F.transform("_kinds", lambda m: pseudonym(m["x"], m["k"], key))
    pieces = F.split(t, PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(pieces, changed, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    real = F.filter("_kinds", lambda m: m["k"].isNotNull())
    any_real = F.col("_kinds").isNotNull() & (F.size(real) > 0)
    new = named.withColumn("_new", F.when(any_real, rebuilt).otherwise(t))
    size = lambda x: F.when(F.col("_kinds").isNull(), F.lit(0)).otherwise(F.size(x)).cast("long")
    added = {text: F.col("_new")}
    if length and length in docs.columns:
        old = F.col("_row").getField(length)
        added[length] = F.when(any_real, F.length("_new").cast(docs.schema[length].dataType)).otherwise(old)
    if counts:
        added |= {f"n_{k}": size(F.filter("_kinds", _is(k))) for k in KINDS} | {"n_private": size(real)}
    return unboxed(new, docs.columns, **added)

"""Checks of identifiers and hosts, as native expressions over a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CARD_ISSUERS = (
    ("^4", (13, 16, 19)),
    ("^5[1-5]", (16,)),
    (r"^(?:222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)", (16,)),
    ("^3[47]", (15,)),
    ("^6(?:011|4[4-9]|5)", (16, 17, 18, 19)),
    (r"^35(?:2[89]|[3-8]\d)", (16, 17, 18, 19)),
    ("^3(?:0[0-5]|[689])", (14, 15, 16, 17, 18, 19)),
)
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
INTERNAL_SUFFIXES = ("local", "internal", "corp", "lan", "intranet", "intra")
ZONE_LABELS = ("ad", "ds")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[ \t-]", "")


def digit(value: Column, i: int) -> Column:
    return F.substring(value, i + 1, 1).cast("int")


def is_card(value: Column) -> Column:
    d = digits(value)
    issuer = F.lit(False)
    for start, lengths in reversed(CARD_ISSUERS):
        issuer = F.when(d.rlike(start), F.length(d).isin(*lengths)).otherwise(issuer)
    return F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*\d$") & issuer & F.call_function("luhn_check", d)


def is_ipv4(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: o.rlike(r"^(?:0|[1-9]\d{0,2})\z") & (o.try_cast("int") <= 255))


def is_private_ipv4(host: Column) -> Column:
    a, b = (F.get(F.split(host, r"\."), F.lit(i)).try_cast("int") for i in (0, 1))
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    return host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}\z") & is_ipv4(host) & F.coalesce(private, F.lit(False))


def is_ipv6(value: Column) -> Column:
    halves = F.split(value, "::", -1)
    groups = F.flatten(F.transform(halves, lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))))
    count = F.when(F.size(halves) == 2, F.size(groups) <= 7).otherwise(F.size(groups) == 8)
    return value.contains(":") & ~value.contains(":::") & (F.size(halves) <= 2) & F.forall(groups, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}\z")) & count


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"^(?i)[a-z][a-z0-9+.-]*://", ""), r"^[^/:?#]*", 0))


def is_internal_host(host: Column) -> Column:
    name = F.lower(host)
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    internal = F.exists(labels, lambda x: x.isin(*INTERNAL_SUFFIXES))
    zone = F.exists(F.slice(labels, F.lit(2), F.greatest(F.size(labels), F.lit(1))), lambda x: x.isin(*ZONE_LABELS))
    server = F.coalesce(F.get(labels, F.lit(0)), F.lit("")).rlike(r"^(?:[a-z]+[0-9]{1,4}|[a-z]{2,8}-[a-z0-9]*[0-9][a-z0-9-]*)\z")
    return is_private_ipv4(name) | ~name.contains(".") | name.endswith(".onmicrosoft.com") | internal | (zone & server)


def has_internal_label(host: Column) -> Column:
    return F.exists(F.split(F.lower(host), r"\."), lambda x: x.isin(*INTERNAL_SUFFIXES, *ZONE_LABELS))


def is_sin(value: Column) -> Column:
    d = digits(value)
    return d.rlike(r"^[1-79]\d{8}\z") & F.call_function("luhn_check", d)


def is_ssn(value: Column) -> Column:
    return digits(value).rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}\z")


def is_aba(value: Column) -> Column:
    total = sum(((3, 7, 1)[i % 3] * digit(value, i) for i in range(9)), F.lit(0))
    return value.rlike(r"^\d{9}\z") & (value != "000000000") & (total % 10 == 0)


def is_itin(value: Column) -> Column:
    d = digits(value)
    middle = F.substring(d, 4, 2).try_cast("int")
    return d.rlike(r"^9\d{8}\z") & (middle.between(70, 88) | middle.between(90, 92) | middle.between(94, 99))


def is_dea(value: Column) -> Column:
    d = [F.substring(value, i + 3, 1).try_cast("int") for i in range(7)]
    return value.rlike(r"^[A-Za-z]{2}\d{7}\z") & ((d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6])


def is_iban(value: Column) -> Column:
    """Of a value without spaces: known country and length, and remainder 1 by 97."""
    compact = F.upper(value)
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    expected = F.element_at(lengths, F.substring(compact, 1, 2))
    chars = F.split(F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4)), "")
    step = lambda r, c: F.when(c.rlike("[A-Z]"), (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + c.try_cast("int")) % 97)
    remainder = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step)
    return F.coalesce(F.length(compact) == expected, F.lit(False)) & compact.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+\z") & F.coalesce(remainder == 1, F.lit(False))


def is_birth_date(value: Column, as_of_year: int) -> Column:
    """A calendar date from 1900 to as_of_year: ISO, slashed in either order, or with a month's name."""
    part = lambda p, g: F.regexp_extract(value, p, g)
    slashed, written = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\z", r"^([A-Z][a-z]+) (\d{1,2}),? (\d{4})\z"
    year = part(slashed, 3)
    number = year.try_cast("int")
    full = F.when(F.length(year) == 2, number + F.when(number <= as_of_year % 100, 2000).otherwise(1900)).when(F.length(year) == 4, number)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(written, 1))).cast("int")

    def real(y: Column, m: Column, d: Column) -> Column:
        date = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
        return F.coalesce(y.between(1900, as_of_year) & m.between(1, 12) & date.isNotNull(), F.lit(False))

    a, b = part(slashed, 1).try_cast("int"), part(slashed, 2).try_cast("int")
    iso = real(F.substring(value, 1, 4).try_cast("int"), F.substring(value, 6, 2).try_cast("int"), F.substring(value, 9, 2).try_cast("int"))
    return (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}\z"), iso)
        .when(value.rlike(slashed), real(full, a, b) | real(full, b, a))
        .when(value.rlike(written), real(part(written, 3).try_cast("int"), month, part(written, 2).try_cast("int")))
        .otherwise(F.lit(False))
    )

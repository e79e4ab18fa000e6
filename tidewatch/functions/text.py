"""Host-name and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.ip import OCTET, bind


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def shannon_entropy(text: Column | str) -> Column:
    """Bits per byte of the UTF-8 text; 0 for empty text."""
    # One character per byte, so that lengths are byte counts.
    chars = F.decode(F.encode(_c(text), "utf-8"), "iso-8859-1")

    def bits(s: Column) -> Column:
        n = F.length(s).cast("double")

        def term(acc: Column, char: Column) -> Column:
            return bind((n - F.length(F.replace(s, char, F.lit("")))) / n, lambda p: acc - p * F.log2(p))

        total = F.aggregate(F.array_sort(F.array_distinct(F.split(s, ""))), F.lit(0.0), term)
        return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(total)

    return bind(chars, bits)


def labels(host: Column | str) -> Column:
    return F.split(_c(host), r"\.")


def label_count(host: Column | str) -> Column:
    return F.size(F.filter(labels(host), lambda x: x != ""))


def longest_label(host: Column | str) -> Column:
    return F.array_max(F.transform(labels(host), F.octet_length))


def has_ip_literal(host: Column | str) -> Column:
    """Four consecutive labels form a dotted IPv4 address."""
    return _c(host).rlike(rf"(^|\.){OCTET}(\.{OCTET}){{3}}(\.|$)")


def subdomain(host: Column | str) -> Column:
    """Everything before the last two labels, trailing dot included."""
    parts = labels(host)
    keep = F.size(parts) - 2
    return F.when(keep > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(1))), "."), F.lit("."))).otherwise("")


def tld(host: Column | str) -> Column:
    return F.lower(F.element_at(labels(host), -1))


def tokens(host: Column | str) -> Column:
    return F.split(F.lower(_c(host)), "[.-]")


def has_label(host: Column | str, label: Column | str) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.array_contains(tokens(host), label)


def suffixes(host: Column | str) -> Column:
    """The name and every parent domain of it."""
    parts = labels(host)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def basename(path: Column | str) -> Column:
    """Last component, trailing slashes ignored; empty text when there is none."""
    name = F.element_at(F.split(F.rtrim(_c(path), F.lit("/")), "/"), -1)
    return F.when(name.isin(".", ".."), "").otherwise(name)


def starts_with_any(text: Column | str, prefixes: list[str]) -> Column:
    result = F.lit(False)
    for prefix in prefixes:
        result = result | _c(text).startswith(prefix)
    return result


def app_name(path: Column | str, default: str = "Unknown app") -> Column:
    path = _c(path)
    name = basename(path)
    return F.when(path.isNull() | (name == ""), default).otherwise(name)


def app_bundle(path: Column | str) -> Column:
    """Outermost parent directory ending in ``.app``; null when there is none."""
    found = F.regexp_extract(_c(path), r"(?i)^(.*?/[^/]+\.app)/", 1)
    return F.nullif(found, F.lit(""))


def fixed(value: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", _c(value).cast("double"))


def evidence_json(evidence: Column | str) -> Column:
    return F.to_json(_c(evidence))


def parse_evidence(text: Column | str) -> Column:
    return F.from_json(_c(text), "array<struct<description:string,detail:string>>")


def compact_id(value: Column | str) -> Column:
    """Text as bytes, the 32 digits of a digest in half the room; ``full_id`` gives it back."""
    value = F.col(value) if isinstance(value, str) else value
    digest = F.concat(F.unhex(F.lit("01")), F.unhex(value))
    return F.when(value.rlike("^[0-9a-f]{32}$"), digest).otherwise(F.concat(F.unhex(F.lit("00")), value.cast("binary")))


def full_id(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    rest = F.substring(value, 2, 2**31 - 1)
    return F.when(F.substring(value, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))

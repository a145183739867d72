"""Scalar text, date and licence functions (F1-F13, F15, F18-F20, F22, F23, F30, F31, F44-F47, F50) as Column expressions."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space of Unicode, which trim() alone doesn't cover.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def optional_text(x: Column) -> Column:
    """Without outer white space; blank is null (F1)."""
    return F.nullif(F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def optional_float(x: Column) -> Column:
    """A finite number, or null (F2)."""
    v = optional_text(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def strict_bool(x: Column) -> Column:
    """true, false or blank; anything else is an error."""
    t = F.lower(optional_text(x))
    return F.when(t.isNull(), F.lit(None).cast("boolean")).when(t == "true", True).when(t == "false", False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), x)).cast("boolean"))


def split_list(x: Column, sep: str = r"\|") -> Column:
    """Parts without blanks; a repeated part is an error."""
    parts = F.filter(F.transform(F.split(x, sep), optional_text), lambda p: p.isNotNull())
    return F.when(F.size(parts) == F.size(F.array_distinct(parts)), parts).otherwise(F.raise_error(F.concat(F.lit("repeated part: "), x)).cast("array<string>"))


def leading_year(x: Column) -> Column:
    """four digits at the start, alone or before a hyphen."""
    return F.nullif(F.regexp_extract(x, r"^(\d{4})(?:-|$)", 1), F.lit("")).cast("int")


def temporal_band(year: Column, snapshot_year: Column | int) -> Column:
    """six bands, the last up to the snapshot's year."""
    return (
        F.when(year.isNull(), "undated_or_unparseable").when((year < 1600) | (year > snapshot_year), "outside_declared_valid_year_range").when(year < 1900, "pre_1900_historical")
        .when(year < 1950, "1900_1949_historical").when(year < 2000, "1950_1999").otherwise("2000_snapshot_year")
    )


def category(x: Column, known: dict[str, str], default: str) -> Column:
    """a mapped category; what isn't known is the default."""
    pairs = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    return F.coalesce(pairs[F.lower(optional_text(x))], F.lit(default))


def percent_encode(x: Column) -> Column:
    """F8: every byte but unreserved ones as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


#: Fixed value: terms of a rights text that restrict what may be done with copies.
RESTRICTIVE = r"(?i)non[ -]?commercial|cc[ -]?by[ -]?nc|no[ -]?derivatives|cc[ -]?by[ -]?nd|share[ -]?alike|cc[ -]?by[ -]?sa"


def restricted(x: Column) -> Column:
    """does a rights text restrict its use? A screen, not a legal conclusion; null texts don't."""
    return F.coalesce(F.rlike(x, F.lit(RESTRICTIVE)), F.lit(False))


def any_filled(*xs: Column) -> Column:
    """F10."""
    return F.coalesce(*map(optional_text, xs)).isNotNull()


def without_subgenus(x: Column) -> Column:
    """F11."""
    return F.regexp_replace(x, r"\s*\([^)]*\)", "")


def comparable(x: Column) -> Column:
    """lower case, single spaces."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(x), f"{SPACE}+", " ")), F.lit(""))


def mismatches(**pairs: tuple[Column, Column]) -> Column:
    """names of the pairs that differ, where both are known."""
    return F.array_compact(F.array(*[F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(n)) for n, (a, b) in pairs.items()]))


def licence_code(x: Column) -> Column:
    """a licence URL or name as a code such as cc-by-4.0; null if it isn't one."""
    t = F.lower(optional_text(x))
    url = r"creativecommons\.org/(?:licenses|publicdomain)/([a-z-]+)/(\d\.\d)"
    name = r"^cc[ -]?(by(?:-(?:nc|sa|nd)){0,2})[ -]?(\d\.\d)?$"
    kind, version = F.nullif(F.regexp_extract(t, url, 1), F.lit("")), F.regexp_extract(t, url, 2)
    named, named_version = F.nullif(F.regexp_extract(t, name, 1), F.lit("")), F.nullif(F.regexp_extract(t, name, 2), F.lit(""))
    zero = F.rlike(t, F.lit(r"^cc[ -]?0(?:[ -]1\.0)?$")) | (kind == "zero")
    return F.when(zero, "cc0-1.0").when(kind == "mark", "pdm-1.0").when(kind.isNotNull(), F.concat_ws("-", F.lit("cc"), kind, version)).when(named.isNotNull(), F.concat_ws("-", F.lit("cc"), named, F.coalesce(named_version, F.lit("4.0"))))


def licence_decision(codes: Column, allowed: tuple[str, ...]) -> Column:
    """one allowed licence is allowed, several or none are quarantined, another is denied."""
    known = F.array_distinct(F.array_compact(codes))
    return F.when(F.size(known) != 1, "quarantined").when(known[0].isin(*allowed), "allowed").otherwise("denied")


def external_id(url: Column, host: str, part: str) -> Column:
    """the number after a path part of a host's URL."""
    ours = F.coalesce(F.try_parse_url(url, F.lit("HOST")).endswith(host), F.lit(False))
    return F.when(ours, F.nullif(F.regexp_extract(url, rf"/{part}/(\d+)", 1), F.lit("")))


def slug(x: Column) -> Column:
    """F22."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def letter_tokens(x: Column) -> Column:
    """F23."""
    return F.regexp_count(x, F.lit(r"\p{L}+"))


#: Below it doubles have fewer than 15 digits of their own.
LEAST_NORMAL = 2.0**-1022


def shortest_digits(x: Column) -> Column:
    """A positive finite double in scientific notation with the fewest digits that read back as the same; of those the closest.

    Of a normal double at most one number of 15 digits reads back as it, so that one is right, without its last zeros.
    Others (16 or 17 digits, subnormals) are written in Arrow batches.
    """
    @F.pandas_udf("string")
    def longer(s: pd.Series) -> pd.Series:
        def text(v: float) -> str | None:
            if v != v:
                return None
            t = Decimal(repr(v)).as_tuple()
            digits = "".join(map(str, t.digits))
            return f"{digits[0]}.{digits[1:]}e{len(digits) - 1 + t.exponent}"

        return s.map(text)

    short = F.format_string("%.14e", x)
    fits = (x >= LEAST_NORMAL) & (short.try_cast("double") == x)
    return F.when(fits, short).otherwise(longer(F.when(~fits, x)))


def json_number(x: Column) -> Column:
    """a double as RFC 8785 writes it, with the fewest digits that read back as the same; an error for NaN and infinity."""
    value = x.cast("double")
    finite = (value != 0) & ~F.isnan(value) & (F.abs(value) != float("inf"))
    zeros = lambda k: F.repeat(F.lit("0"), k.cast("int"))

    def written(p: Column) -> Column:
        """From the digits and the place of the point behind the first of them."""
        digits, point, n = p["digits"], p["point"], F.length(p["digits"])
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        return (
            F.when((n <= point) & (point <= 21), F.concat(digits, zeros(point - n))).when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
            .otherwise(F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string")))
        )

    # arrays of one, so that each step's terms are computed once
    split = F.transform(F.array(shortest_digits(F.when(finite, F.abs(value)))), lambda t: F.struct(
        F.rtrim(F.regexp_replace(F.substring_index(t, "e", 1), r"\.", ""), F.lit("0")).alias("digits"), (F.substring_index(t, "e", -1).cast("int") + 1).alias("point")
    ))
    plain = F.element_at(F.transform(split, written), 1)
    bad = F.raise_error(F.lit("no JSON number: NaN or infinity")).cast("string")
    return F.when(value.isNull(), "null").when(F.isnan(value) | (F.abs(value) == float("inf")), bad).when(value == 0, "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), plain))


def json_text(x: Column) -> Column:
    """A string as JSON writes it, with the shortest escapes; null as null."""
    quoted = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNull(), "null").otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def canonical_json(**fields: Column) -> Column:
    """fields by name, compact, nulls kept. For strings, integers, booleans and arrays of them; doubles via jcs()."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def jcs(**fields: Column) -> Column:
    """the RFC 8785 form of an object from the JSON texts of its fields, given by json_text(), json_number() and the like."""
    parts = [F.concat(F.lit(f'"{n}":'), fields[n]) for n in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON with a final newline."""
    return F.sha2(F.concat(canonical_json(**fields), F.lit("\n")), 256)


def content_id(prefix: str, digest: Column) -> Column:
    """F31."""
    return F.concat(F.lit(f"{prefix}:v1:"), F.substring(digest, 1, 24))


def utc_time(x: Column) -> Column:
    """an RFC 3339 time with a zone; null without one."""
    return F.when(F.rlike(x, F.lit(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$")), F.try_to_timestamp(x))


def retry_after_s(x: Column, now_s: Column) -> Column:
    """seconds, or the seconds until an HTTP date."""
    http = F.try_to_timestamp(F.regexp_extract(x, r"^\w{3}, (\d\d \w{3} \d{4} \d\d:\d\d:\d\d) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(F.rlike(x, F.lit(r"^\d+$")), x.try_cast("long")), F.greatest(F.lit(0), F.unix_timestamp(http) - now_s))


def media_type(content: Column) -> Column:
    """by magic bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")


def urn(*parts: Column | str) -> Column:
    """F50."""
    return F.concat_ws(":", F.lit("urn"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def normalised(x: Column) -> Column:
    """NFKC and case folding (F13): as lower case where the text is ASCII, in Arrow batches where it isn't."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    ascii_only = F.rlike(x, F.lit(r"^[\x00-\x7F]*$"))
    return F.when(ascii_only, F.lower(x)).otherwise(fold(F.when(~ascii_only, x)))


def prefixed_fingerprint(canonical: Column) -> Column:
    """F30, the flavour that strips the final newline and names its hash."""
    return F.concat(F.lit("sha256:"), F.sha2(F.regexp_replace(canonical, r"\n$", ""), 256))

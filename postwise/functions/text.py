"""Text cleaning and extraction (F1, F3, F3b, P18) as Column expressions.

Everything runs JVM-side (regexp_replace / regexp_extract_all / higher-order
array functions). The only Python path is the opt-in legacy HTML unescape.
"""

from __future__ import annotations

import functools
import html as _html
import html.entities as _entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_PROFILE, Profile
from .values import col

@functools.cache
def _named_entities() -> str:
    """The HTML5 entity names (of the standard library) with their characters, the
    most frequent ones first: one literal, which the optimizer turns into a map."""
    first = ("amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "middot", "rsquo", "lsquo", "ndash", "mdash")
    names = {n[:-1]: v for n, v in _entities.html5.items() if n.endswith(";")}
    return "\u0001".join(f"{n}\u0002{names[n]}" for n in dict.fromkeys((*first, *names)))


# References to 128-159 mean the Windows-1252 character, where it has one
_C1_CHARACTERS = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))


def _numeric_entity(name: Column) -> Column:
    """Character of ``#65`` or ``#x41`` ('' for control codes and noncharacters, U+FFFD for
    numbers that name none)."""
    code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(
        F.substr(name, F.lit(2))).cast("bigint")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(code.between(128, 159), F.substr(F.lit(_C1_CHARACTERS), (code - 127).cast("int"), F.lit(1)))
            .when(code.between(1, 8) | code.between(14, 31) | code.isin(11, 127) | code.between(0xFDD0, 0xFDEF)
                  | (code.bitwiseAND(0xFFFE) == 0xFFFE), F.lit("")).otherwise(char))


@functools.cache
def _legacy_names() -> str:
    """An alternation of the names that HTML5 knows without ';', longest first, so the
    longest prefix of a reference is the one that matches."""
    return "|".join(sorted((n for n in _entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def unescape_native(c: Column) -> Column:
    """One decoding pass over every reference, JVM-side, as HTML5 reads them: the text is
    cut at its ampersands and each piece starts with a reference or keeps its '&'. A
    name with ';' counts whole; else the longest name known without ';' that the piece
    starts with (``&notit;`` is ``¬it;``). Numbers need no ';'. A text without '&' costs
    one test."""
    names = F.str_to_map(F.lit(_named_entities()), F.lit("\u0001"), F.lit("\u0002"))
    whole = r"^([A-Za-z][A-Za-z0-9]{0,31});"
    number = r"^#([0-9]{1,8}|[xX][0-9a-fA-F]{1,7})"
    legacy = f"^({_legacy_names()})"

    # what was found stands beside the piece: a lambda's body repeats what it names twice
    def cut(p: Column) -> Column:
        return F.struct(F.regexp_extract(p, whole, 1).alias("whole"), p.alias("p"))

    def look(x: Column) -> Column:
        p = x["p"]
        char = F.when(x["whole"] != "", F.try_element_at(names, x["whole"]))
        prefix = F.when(char.isNull() & p.startswith("#"), F.regexp_extract(p, number, 0)).when(
            char.isNull(), F.regexp_extract(p, legacy, 0))
        return F.struct(char.alias("char"), F.coalesce(prefix, F.lit("")).alias("prefix"), x["whole"].alias("whole"), p.alias("p"))

    def piece(x: Column) -> Column:
        p, prefix = x["p"], x["prefix"]
        after = F.length(prefix) + 1
        by_prefix = F.when(prefix.startswith("#"), F.concat(
            _numeric_entity(prefix), F.substr(p, after + F.when(F.substr(p, after, F.lit(1)) == ";", 1).otherwise(0)))).when(
            prefix != "", F.concat(F.try_element_at(names, prefix), F.substr(p, after)))
        return F.coalesce(F.concat(x["char"], F.substr(p, F.length(x["whole"]) + 2)), by_prefix, F.concat(F.lit("&"), p))

    pieces = F.transform(F.transform(F.transform(F.slice(F.split(c, "&"), 2, 2**30), cut), look), piece)
    return F.when(c.contains("&"), F.concat(F.substring_index(c, "&", 1), F.array_join(pieces, ""))).otherwise(c)


def _unescape_full_udf():
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def unescape_full(s):
        return s.map(lambda v: _html.unescape(v) if isinstance(v, str) else v)

    # real type objects (this module postpones annotations)
    unescape_full.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf(unescape_full, "string")


def unescape(c: Column, full: bool = False) -> Column:
    """HTML entity decoding; with ``full`` by the standard library in a pandas UDF."""
    return _unescape_full_udf()(c) if full else unescape_native(c)


def html_to_text(raw, max_len: int | None = C.DESCRIPTION_MAX, full_unescape: bool = False) -> Column:
    """drop script/style blocks, unescape once, strip tags (also encoded ones),
    collapse whitespace, trim, then cut the cleaned text at ``max_len`` characters."""
    s = F.coalesce(col(raw).cast("string"), F.lit(""))
    s = F.regexp_replace(s, C.SCRIPT_BLOCK_PATTERN, " ")
    s = F.regexp_replace(s, C.STYLE_BLOCK_PATTERN, " ")
    s = unescape(s, full_unescape)
    s = F.regexp_replace(s, C.TAG_PATTERN, " ")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.substring(s, 1, max_len) if max_len else s


def truncate(c, n: int) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(col(c), 1, n)


MAILTO_PATTERN = C.MAILTO_PATTERN
ADDRESS_PATTERN = C.ADDRESS_PATTERN
ROLE_ACCOUNT_PATTERN = C.ROLE_ACCOUNT_PATTERN


def email_ok(e: Column, profile: Profile = DEFAULT_PROFILE) -> Column:
    local = F.substring_index(e, "@", 1)
    domain = F.when(e.contains("@"), F.split_part(e, F.lit("@"), F.lit(2))).otherwise(F.lit(""))
    bad_domain = F.lit(False)
    for part in profile.email_blocked_domain_parts:
        bad_domain = bad_domain | domain.contains(part)
    return (
        ~local.rlike(profile.role_accounts)
        & ~bad_domain
        & (F.length(local) >= profile.email_min_local)
        & domain.contains(".")
    )


def extract_emails(html, profile: Profile = DEFAULT_PROFILE) -> Column:
    """recruiter-looking addresses (mailto links and plain addresses), lower-case,
    distinct, role accounts and test/system domains removed. Order is not meaningful."""
    h = F.coalesce(col(html), F.lit(""))
    found = F.concat(
        F.regexp_extract_all(h, F.lit(MAILTO_PATTERN), 1),
        F.regexp_extract_all(h, F.lit(ADDRESS_PATTERN), 1),
    )
    cleaned = F.array_distinct(F.transform(found, lambda x: F.trim(F.lower(x))))
    return F.filter(cleaned, lambda e: email_ok(e, profile))


def first_email(html, profile: Profile = DEFAULT_PROFILE) -> Column:
    """One address per page — the smallest, so the pick is deterministic."""
    return F.array_min(extract_emails(html, profile))

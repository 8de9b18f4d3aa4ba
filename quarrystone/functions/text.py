"""Text as columns: names normalised, tokens, scores, bounded previews, redaction. All of it stays in the JVM."""

from __future__ import annotations

import functools
import ipaddress
import string
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is taken out of previews. The first two keep their first group.
REDACTIONS = (
    (r"(?i)(authorization\s*[:=]\s*bearer\s+)([^\s\"']+)", "$1<redacted>"),
    (r"(?i)(bearer\s+)([A-Za-z0-9._~+/=-]{8,})", "$1<redacted>"),
    (r"\b(sk-[A-Za-z0-9_-]{8,})\b", "<redacted>"),
    (r"\b(gh[pousr]_[A-Za-z0-9]{8,})\b", "<redacted>"),
    (r"\b(xox[baprs]-[A-Za-z0-9-]{8,})\b", "<redacted>"),
)
#: All characters that are white space.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SENSITIVE_PATH = r"(?i)(credential|authorization|api[_ -]?key|token|password|passwd|secret)"


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """(characters, what stands for them, characters that several stand for): letters and digits of all of Unicode as a-z and 0-9.

    By the rules of compatibility decomposition and case folding; combining marks, at the end of the first string, go.
    """
    single, gone, several = {}, [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        kept = "".join(x if x in string.ascii_lowercase + string.digits else " " for x in plain)
        if not plain:
            gone.append(c)
        elif kept.strip():
            (single if len(kept) == 1 else several)[c] = kept
    return "".join([*single, *gone]), "".join(single.values()), several


def normalise(text: Column) -> Column:
    """Case folded, without accents, compatibility forms as what they stand for; runs of anything else than a-z and 0-9 as one space."""
    before, after, several = _folds()
    wide, near = "[" + "".join(several) + "]", "".join(c for c in several if c < "\u0250" and c != "ß")
    stands_for = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])

    def apart(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(wide), F.lit(0)))
        return F.aggregate(found, t, lambda out, c: F.replace(out, c, F.element_at(stands_for, c)))

    # Most texts have no character that several stand for but the sharp s; a small class tells which may have one.
    plain = F.replace(text, F.lit("ß"), F.lit("ss"))
    plain = F.when(text.rlike(f"[{near}]|[^\\x00-\u024f]"), apart(plain)).otherwise(plain)
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(plain, before, after)).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """All tokens of a document, in order."""
    return F.filter(F.split(normalise(text), " "), lambda t: t != "")


def query_tokens(text: Column) -> Column:
    """Distinct tokens of three characters and more."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 3))


def lexical_score(wanted: Column, found: Column) -> Column:
    """Share of the wanted tokens that are found; 0 without any wanted token."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted)).otherwise(F.lit(0.0))


def stripped(text: Column) -> Column:
    """Without white space, in Unicode's sense, at either end."""
    return F.btrim(text, F.lit(WHITE))


def bounded(text: Column, limit: int) -> Column:
    """text, or its first limit - 1 characters and an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def redacted(text: Column, limit: int = 400, newlines: bool = False) -> Column:
    """A preview without credentials; newlines: also put spaces for them."""
    for pattern, new in REDACTIONS:
        text = F.regexp_replace(text, pattern, new)
    text = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")) if newlines else F.btrim(F.replace(text, F.lit("\r"), F.lit(" ")), F.lit(" \t\n\x0b\f"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def masked(text: Column) -> Column:
    """The first and last two characters of a long value, else only stars."""
    return F.when(F.length(text) <= 8, F.lit("***")).otherwise(F.concat(F.substring(text, 1, 2), F.lit("***"), F.right(text, F.lit(2))))


def path_is_sensitive(path: Column) -> Column:
    return path.rlike(SENSITIVE_PATH)


def is_expression(value: Column) -> Column:
    """A template: it starts with = or holds double braces."""
    return F.startswith(F.ltrim(value), F.lit("=")) | F.contains(value, F.lit("{{")) | F.contains(value, F.lit("}}"))


def leaf_key(path: Column) -> Column:
    """The last key of a path, in lower case, without its index."""
    return F.lower(F.split_part(F.element_at(F.split(path, "\\."), -1), F.lit("["), F.lit(1)))


def safe_token(value: Column) -> Column:
    """value if it is a plain identifier of at most 128 characters, else null."""
    return F.when(value.rlike(r"^[A-Za-z0-9_.:/@-]{1,128}\z"), value)


# Networks that are private, loopback, link-local or reserved, and what is public inside them.
INNER_4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PUBLIC_4 = ("192.0.0.9/32", "192.0.0.10/32")
INNER_6 = ("::/3", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/2", "8000::/2", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10")
PUBLIC_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
#: A group of an IPv4 address, which has no zero in front.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _inside(parts: Column, width: int, networks: tuple[str, ...]) -> Column:
    """Is an address, as an array of numbers of width bits, in any of the networks?"""
    found = F.lit(False)
    for network in map(ipaddress.ip_network, networks):
        first, same, left = int(network.network_address), F.lit(True), network.prefixlen
        for k in range(network.max_prefixlen // width):
            used = min(width, max(0, left - k * width))
            part = first >> network.max_prefixlen - (k + 1) * width & (1 << width) - 1
            same = same & (F.shiftright(F.get(parts, F.lit(k)), width - used) == part >> width - used) if used else same
        found = found | same
    return found


def _octets(address: Column) -> Column:
    return F.transform(F.split(address, "\\."), lambda x: x.try_cast("int"))


def inner_4(address: Column) -> Column:
    """Is it an IPv4 address of an inner network?"""
    parts = _octets(address)
    return address.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}\z") & _inside(parts, 8, INNER_4) & ~_inside(parts, 8, PUBLIC_4)


def inner_6(address: Column) -> Column:
    """Is it an IPv6 address of an inner network? Addresses that map IPv4 ones lie in a reserved network, all of them."""
    bare = F.lower(F.split_part(address, F.lit("%"), F.lit(1)))
    tail = F.regexp_extract(bare, rf":({_OCTET}(?:\.{_OCTET}){{3}})\z", 1)
    pair = lambda k: F.hex(F.shiftleft(F.get(_octets(tail), F.lit(k)), 8) + F.get(_octets(tail), F.lit(k + 1)))
    plain = F.when(tail != "", F.concat(F.left(bare, F.length(bare) - F.length(tail)), F.lower(pair(0)), F.lit(":"), F.lower(pair(2)))).otherwise(bare)
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    short, head, rest = F.contains(plain, F.lit("::")), groups(F.split_part(plain, F.lit("::"), F.lit(1))), groups(F.split_part(plain, F.lit("::"), F.lit(2)))
    padded = F.when(short, F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(rest))), rest)).otherwise(head)
    valid = plain.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?\z") & (F.size(padded) == 8) & (~short | (F.size(head) + F.size(rest) < 8))

    numbers = F.transform(padded, lambda g: F.conv(g, 16, 10).try_cast("int"))
    return F.coalesce(valid, F.lit(False)) & F.coalesce(F.transform(F.array(numbers), lambda parts: _inside(parts, 16, INNER_6) & ~_inside(parts, 16, PUBLIC_6))[0], F.lit(False))


def host_of(url: Column) -> Column:
    """The host of an http(s) URL, in lower case, an IPv6 address without its brackets; null for anything else."""
    bare = F.regexp_replace(stripped(F.ltrim(url, F.lit("="))), r"[\t\r\n]", "")
    named = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[hH][tT][tT][pP][sS]?://([^/?#]*)", 1), r"(?s)^.*@", "")
    host = F.lower(F.regexp_extract(named, r"(?s)^(?:\[([^\]]*)\]|([^:\[]*))", 0))
    return F.nullif(F.regexp_replace(host, r"[\[\]]", ""), F.lit(""))


def private_or_local(url: Column) -> Column:
    """An http(s) URL whose host is local, private, loopback, link-local or reserved; templates are not judged."""
    templated = F.contains(url, F.lit("{{")) | F.contains(url, F.lit("$env"))

    def judged(host: Column) -> Column:
        local = host.isin("localhost", "localhost.localdomain") | F.endswith(host, F.lit(".local"))
        return F.coalesce(F.when(F.contains(host, F.lit(":")), inner_6(host)).otherwise(local | inner_4(host)), F.lit(False))

    return F.when(F.coalesce(~templated & F.contains(url, F.lit(":")), F.lit(False)), F.transform(F.array(host_of(url)), judged)[0]).otherwise(F.lit(False))


def websearch(text_tokens: Column, query: str) -> Column:
    """Does a document match a web-style query: words are all needed, `or`, `-word` and "phrases" as usual; a blank query matches all."""
    import re

    groups: list[Column] = []
    pending_or = False
    for quoted, word in re.findall(r'(-?"[^"]*")|(\S+)', query):
        raw = quoted or word
        if raw.lower() == "or":
            pending_or = bool(groups)
            continue
        negative, raw = raw.startswith("-"), raw.lstrip("-").strip('"')
        parts = [p for p in re.split(r"[^a-z0-9]+", raw.lower()) if p]
        if not parts:
            continue
        joined = F.concat(F.lit(" "), F.array_join(text_tokens, " "), F.lit(" "))
        match = F.array_contains(text_tokens, parts[0]) if len(parts) == 1 else F.contains(joined, F.lit(" " + " ".join(parts) + " "))
        match = ~match if negative else match
        groups = [*groups[:-1], groups[-1] | match] if pending_or else [*groups, match]
        pending_or = False
    out = F.lit(True)
    for g in groups:
        out = out & g
    return out


def rank_of(text_tokens: Column, query: str) -> Column:
    """Own rank: occurrences of the query's words over document length, damped; equal inputs rank equally."""
    import re

    words = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if w and w != "or"]
    hits = F.size(F.filter(text_tokens, lambda t: t.isin(*words))) if words else F.lit(0)
    return F.round(hits / (F.size(text_tokens) + F.lit(50.0)), 6)

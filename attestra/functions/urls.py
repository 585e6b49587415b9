"""Public HTTPS addresses and what they say about their source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host names that are never public.
LOCAL_NAMES = ("localhost",)
LOCAL_SUFFIXES = (".local", ".localhost", ".internal")
# IPv4 ranges that aren't public, as a pattern of dotted quads.
PRIVATE_QUADS = r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01])|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])|22[4-9]|2[3-5][0-9])(\.[0-9]+)+$"

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, i)


def host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty where the address isn't absolute."""
    bare = F.regexp_replace(_part(url, 2), r"^[^@]*@", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r":[0-9]*$", "")), r"\.+$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(_part(url, 2), r":([0-9]+)$", 1)


def public_https(url: Column) -> Column:
    """The normal form, or null: HTTPS only, no user, port 443 at most, no local host or private address; without fragment.

    Literal IPv6 addresses aren't taken.
    """
    name, at = host(url), port(url)
    local = name.isin(*LOCAL_NAMES) | name.rlike(PRIVATE_QUADS) | name.startswith("[")
    for suffix in LOCAL_SUFFIXES:
        local = local | name.endswith(suffix)
    good = (F.lower(_part(url, 1)) == "https") & (name != "") & ~_part(url, 2).contains("@") & at.isin("", "443") & ~local
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    query = F.when(_part(url, 4) == "?", "").otherwise(_part(url, 4))
    return F.when(good, F.concat(F.lit("https://"), name, F.when(at != "", F.concat(F.lit(":"), at)).otherwise(""), path, query))


def family_origin(url: Column) -> Column:
    """Scheme and host, and a port other than 443."""
    at = port(url)
    return F.concat(F.lit("https://"), host(url), F.when((at != "") & (at != "443"), F.concat(F.lit(":"), at)).otherwise(""))


def in_domain(name: Column, domain: str) -> Column:
    return (name == domain) | name.endswith("." + domain)


def trust_tier(url: Column, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """T1 or T2 for the listed domains and their subdomains, the first list first; else T4."""
    name = host(url)
    any_of = lambda domains: F.exists(F.array(*(F.lit(d) for d in domains)), lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d))) if domains else F.lit(False)
    return F.when(any_of(first), "T1").when(any_of(second), "T2").otherwise("T4")

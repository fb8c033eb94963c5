"""URL functions, JVM-side. Anything that is no http(s) URL gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that track and do not identify.
TRACKING = ("gclid", "fbclid")


def scheme(u: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))


def host(u: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def domain(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^www\.", "")


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def parameters(u: Column) -> Column:
    """Query parameters that identify, ascending."""
    parts = F.filter(F.split(query(u), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    return F.array_sort(F.filter(parts, lambda p: ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING)))


def canonical(u: Column) -> Column:
    """Scheme and host in lower case, path without closing slashes, no query."""
    return F.concat(scheme(u), F.lit("://"), host(u), F.regexp_replace(path(u), "/+$", ""))


def url_key(u: Column) -> Column:
    """What tells listings apart: tracking parameters and fragment gone, the others in order."""
    bare = F.regexp_replace(path(u), "/+$", "")
    kept = F.array_join(parameters(u), "&")
    whole = F.concat(scheme(u), F.lit("://"), host(u), F.when(bare == "", "/").otherwise(bare), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(scheme(u).isin("http", "https"), whole)


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))

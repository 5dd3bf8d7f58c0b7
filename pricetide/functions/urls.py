"""URL columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([a-zA-Z][\w+.-]*):)?(?://([^/?#]*))?([^?#]*)"


@dataclass(frozen=True)
class UrlRules:
    """How a shop spells its addresses."""

    host: str | None = None          # canonical host; None keeps the (lower-cased) one found
    base: str = ""                   # prefix of relative links, scheme and host
    trailing_slash: bool = False     # canonical form ends with a slash
    product_folder: str | None = None  # fold any ".../<folder>/<slug>" to "/<folder>/<slug>"
    hosts: tuple[str, ...] = field(default=())
    product_paths: tuple[str, ...] = ("/producto/", "/product/", "/tienda/")
    excluded: tuple[str, ...] = ()


def _part(c: Column, index: int) -> Column:
    return F.regexp_extract(c, _PARTS, index)


def canonical_url(c: Column, rules: UrlRules = UrlRules()) -> Column:
    """Scheme, lower-case host and cleaned path; query and fragment are dropped."""
    url = F.trim(c)
    path = F.regexp_replace(F.regexp_replace(_part(url, 3), "/+", "/"), "/$", "")
    if rules.product_folder:
        folder = rules.product_folder
        slug = F.regexp_extract(path, rf"(?i)/{folder}/([^/]+)", 1)
        path = F.when(slug != "", F.concat(F.lit(f"/{folder}/"), slug)).otherwise(path)
    if rules.trailing_slash:
        path = F.concat(path, F.lit("/"))
    if rules.host:
        return F.concat(F.lit(f"https://{rules.host}"), path)
    scheme = F.coalesce(F.nullif(F.lower(_part(url, 1)), F.lit("")), F.lit("https"))
    host = F.lower(_part(url, 2))
    origin = F.when(host == "", F.lit(rules.base)).otherwise(F.concat(scheme, F.lit("://"), host))
    return F.concat(origin, path)


def is_product_url(c: Column, rules: UrlRules = UrlRules()) -> Column:
    lowered = F.lower(c)
    ok = F.lit(False)
    for path in rules.product_paths:
        ok = ok | lowered.contains(path)
    for path in rules.excluded:
        ok = ok & ~lowered.contains(path)
    if rules.hosts:
        ok = ok & F.lower(_part(c, 2)).isin(*rules.hosts)
    return ok


def is_valid_url(c: Column) -> Column:
    return F.lower(_part(c, 1)).isin("http", "https") & (_part(c, 2) != "")

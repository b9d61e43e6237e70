"""URL columns: normalising, host comparison, and resolving links against a page."""

from __future__ import annotations

import re
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import weburl
from corpusmill.functions.text import WHITE, trim


#: URLs that are written as they are normalised, but for case of the host, port and fragment: no escapes, dots, users or names to convert.
_PLAIN = r"^https?://(?:[A-Za-z0-9-]+\.)*(?:[A-Wa-wYyZz][A-Za-z0-9-]*)(?::[1-9][0-9]{0,3})?(?:/(?!\.{1,2}(?:[/?#]|$))[A-Za-z0-9_~!$&()*+,;=:@.-]*)*(?:\?[A-Za-z0-9_~!$&()*+,;=:@/.-]*)?(?:#.*)?\z"


def _normalized(url: Column) -> Column:
    """normalize() as an expression, for URLs that need no more than case, port, fragment and slash."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+", "")
    rest = F.when(rest == "", F.lit("/")).when(F.startswith(rest, F.lit("?")), F.concat(F.lit("/"), rest)).otherwise(rest)
    cut = F.when((F.endswith(rest, F.lit("/"))) & (F.regexp_extract(rest, r"^([^?]*)", 1) != "/"), F.regexp_replace(rest, "/$", "")).otherwise(rest)
    return F.when(head != "", F.concat(head, cut))


def normalize(url: Column) -> Column:
    """One spelling of an http or https URL: as browsers write it (weburl), without fragment, and without a last slash unless the path is `/`. Null for what is no URL.

    Plain URLs stay in the JVM; only the others pass through Python.
    """
    plain = F.coalesce(url.rlike(_PLAIN), F.lit(False))
    return F.when(plain, _normalized(url)).otherwise(_normalize(F.when(~plain, url)))


def host(url: Column) -> Column:
    """Host with a port that is not the scheme's own, in lower case; null where the URL has none."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^.*@", "")
    bare = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    return F.nullif(bare, F.lit(""))


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


#: Trimmed links that lead nowhere. Valid for Python and the JVM alike.
NOWHERE = {"empty": "^$", "fragment": "^#", "script": "^javascript:", "bare extension": r"^\.[a-zA-Z0-9]{1,5}$"}
_NOWHERE = "|".join(NOWHERE.values())
_leads_nowhere = re.compile(_NOWHERE).search
_is_bare = re.compile(NOWHERE["bare extension"]).search
#: Fixed value: a last path segment that names a file.
_is_file = re.compile(r"\.[A-Za-z0-9]+\Z").search


def rejected_link(link: Column) -> Column:
    """Links that lead nowhere: empty, fragments, scripts, and bare extensions."""
    return F.coalesce(trim(link).rlike(_NOWHERE), F.lit(True))


def _spelled(at: weburl.WebUrl) -> str:
    out = str(replace(at, fragment=None))
    return out[:-1] if out.endswith("/") and at.path != "/" else out


def normalize_one(url: str | None) -> str | None:
    at = None if url is None else weburl.parse(url)
    return _spelled(at) if at else None


@F.arrow_udf(T.StringType())
def _normalize(url: pa.Array) -> pa.Array:
    return pa.array([normalize_one(u) for u in url.to_pylist()], pa.string())


def _leaf(path: str) -> str:
    return path.rpartition("/")[2]


def as_directory(at: weburl.WebUrl) -> weburl.WebUrl:
    """The page's URL as links are read against it: with a slash at the end, unless its last segment names a file."""
    return at if at.path.endswith("/") or _is_file(_leaf(at.path)) else replace(at, path=f"{at.path}/")


def resolve_one(link: str | None, base: str | None) -> str | None:
    """The absolute, normalised URL of a link on a page, or None where it leads nowhere."""
    wanted = None if link is None or base is None else link.strip(WHITE)
    if wanted is None or _leads_nowhere(wanted):
        return None
    page = weburl.parse(base)
    found = weburl.parse(wanted, as_directory(page)) if page else None
    return _spelled(found) if found and not _is_bare(_leaf(found.path)) else None


@F.arrow_udf(T.StringType())
def _resolve(link: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([resolve_one(a, b) for a, b in zip(link.to_pylist(), base.to_pylist(), strict=True)], pa.string())


def resolve(link: Column, base: Column) -> Column:
    return _resolve(link, base)

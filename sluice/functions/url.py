"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")


def normalize_url(url: Column) -> Column:
    """Lower-case host without www. and default port, no tracking parameters, no trailing slash; else as it is."""
    part = lambda k: F.regexp_extract(url, PARTS, k)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    kept = F.filter(F.split(F.substr(part(4), F.lit(2)), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.rlike(PARTS), F.concat(scheme, F.lit("://"), host, path, query, part(5))).otherwise(url)


def extract_domain(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(host == "", url).otherwise(host)


def is_web_url(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#]+")


def decode_redirect(url: Column) -> Column:
    """The target of a redirect link whose parameter u is ``a1`` and base64url text; else the link."""
    code = F.regexp_extract(url, r"/ck/a\?(?:[^#]*&)?u=a1([A-Za-z0-9_\-]+)", 1)
    std = F.translate(code, "-_", "+/")
    full = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), "=")
    text = F.decode(F.try_to_binary(full, F.lit("base64")), "UTF-8")
    return F.when((code != "") & text.startswith("http"), text).otherwise(url)

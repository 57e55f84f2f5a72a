"""Urls: canonical form, safety rules and redaction, as columns of tables of any size."""

from __future__ import annotations

import ipaddress
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of query parameters that track campaigns, beside those that begin with utm_.
TRACKING_PARAMS = (
    "gclid",
    "dclid",
    "fbclid",
    "msclkid",
    "mc_cid",
    "mc_eid",
    "igshid",
    "ref",
    "ref_src",
    "ref_url",
    "referrer",
    "source",
    "cmpid",
    "campaign",
    "spm",
    "yclid",
    "_hsenc",
    "_hsmi",
)
DEFAULT_PORTS = {"http": 80, "https": 443}
UNPARSABLE = "<unparsable-url>"


def is_tracking_param(name: Column) -> Column:
    """Whether a query parameter only tracks; case doesn't matter."""
    low = F.lower(name)
    return low.startswith("utm_") | low.isin(*TRACKING_PARAMS)


def _split(raw: str):
    """urlsplit with a checked port, or None."""
    try:
        parts = urlsplit(raw)
        return parts, parts.port
    except ValueError:
        return None


def _canonical(raw: str) -> tuple[str | None, str | None]:
    found = _split(raw.strip())
    if found is None:
        return None, "malformed url"
    parts, port = found
    if parts.username or parts.password:
        return None, "user-info in url"
    if parts.scheme not in DEFAULT_PORTS or not parts.hostname:
        return None, "not an absolute http(s) url"
    host = parts.hostname.lower() + ("" if port in (None, DEFAULT_PORTS[parts.scheme]) else f":{port}")
    query = urlencode(sorted(kv for kv in parse_qsl(parts.query, keep_blank_values=True) if not (kv[0].lower() in TRACKING_PARAMS or kv[0].lower().startswith("utm_"))))
    path = parts.path.rstrip("/") if len(parts.path) > 1 else parts.path
    return urlunsplit((parts.scheme, host, path, query, "")), None


@F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("reason", T.StringType())]))
def canonical_url(urls: pd.Series) -> pd.DataFrame:
    """One form per page: lower-cased scheme and host, no default port, fragment, tracking parameters or trailing
    slashes, other parameters sorted. A url is null with a reason if it is no absolute http(s) url, has a bad port or
    user-info; null stays null, with no reason."""
    done = {u: _canonical(u) for u in urls.dropna().unique()}
    return pd.DataFrame([done.get(u, (None, None)) for u in urls], columns=["url", "reason"])


def _sanitized(raw: str) -> str:
    found = _split(raw)
    if found is None:
        return UNPARSABLE
    parts, port = found
    if not parts.scheme and not parts.hostname:
        return raw
    return urlunsplit((parts.scheme.lower(), (parts.hostname or "") + ("" if port is None else f":{port}"), parts.path, "", ""))


#: A url of plain form: scheme, host of ASCII letters, port, path, query and fragment, without user-info, brackets, spaces or
#: control characters. Its parts are its groups; any other url goes to Python.
PLAIN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([A-Za-z0-9._-]+)(?::([0-9]{1,5}))?(/[^?#\s\p{Cntrl}]*)?(?:\?[^#\s\p{Cntrl}]*)?(?:#[^\s\p{Cntrl}]*)?$"
LARGEST_PORT = 65535


def _is_plain(url: Column) -> Column:
    port = F.regexp_extract(url, PLAIN, 3).try_cast("int")
    return F.coalesce(url.rlike(PLAIN) & (F.coalesce(port, F.lit(0)) <= LARGEST_PORT), F.lit(False))


@F.pandas_udf(T.StringType())
def _sanitized_odd(urls: pd.Series) -> pd.Series:
    return urls.map(_sanitized, na_action="ignore")


def sanitize_url(url: Column | str) -> Column:
    """Scheme, host, port and path only, for messages; ``<unparsable-url>`` if it can't be parsed."""
    url = F.col(url) if isinstance(url, str) else url
    part = [F.regexp_extract(url, PLAIN, i) for i in range(5)]
    port = F.when(part[3] != "", F.concat(F.lit(":"), part[3].try_cast("int").cast("string"))).otherwise("")
    plain = _is_plain(url)
    return F.when(plain, F.concat(F.lower(part[1]), F.lit("://"), F.lower(part[2]), port, part[4])).otherwise(_sanitized_odd(F.when(~plain, url)))


PARTS = T.StructType([T.StructField("scheme", T.StringType()), T.StructField("host", T.StringType()), T.StructField("userinfo", T.BooleanType()), T.StructField("ok", T.BooleanType())])


@F.pandas_udf(PARTS)
def _odd_parts(urls: pd.Series) -> pd.DataFrame:
    def one(u):
        if u is None or (found := _split(u)) is None:
            return None, None, None, False
        parts = found[0]
        return parts.scheme.lower(), (parts.hostname or "").lower() or None, bool(parts.username or parts.password), True

    return pd.DataFrame([one(u) for u in urls], columns=PARTS.names)


def url_safety_parts(url: Column | str) -> Column:
    """scheme, host, whether there is user-info, and whether the url can be parsed; not ok for null."""
    url = F.col(url) if isinstance(url, str) else url
    plain = _is_plain(url)
    own = F.struct(F.lower(F.regexp_extract(url, PLAIN, 1)).alias("scheme"), F.lower(F.regexp_extract(url, PLAIN, 2)).alias("host"), F.lit(False).alias("userinfo"), F.lit(True).alias("ok"))
    return F.when(plain, own.cast(PARTS)).otherwise(_odd_parts(F.when(~plain, url)))


def unsafe_reason(url: Column, allowed_hosts: Column) -> Column:
    """Why a url must not be fetched for a source with these hosts, or null if it may: https only, no user-info, a host
    on the list, a valid port."""
    p = url_safety_parts(url)
    return (
        F.when(~p["ok"], F.lit("unparseable url"))
        .when(p["scheme"] != "https", F.lit("scheme is not https"))
        .when(p["userinfo"], F.lit("user-info in url"))
        .when(p["host"].isNull(), F.lit("no host"))
        .when(~F.coalesce(F.array_contains(F.transform(allowed_hosts, F.lower), p["host"]), F.lit(False)), F.lit("host not on the allowlist"))
    )


OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^((?:{OCTET}\.){{3}}){OCTET}$"


@F.pandas_udf(T.StringType())
def _ipv6_network(addresses: pd.Series) -> pd.Series:
    def one(a: str) -> str | None:
        try:
            return str(ipaddress.IPv6Network((a, 56), strict=False))
        except ValueError:
            return None

    return addresses.map(one, na_action="ignore")


def network_identity(address: Column | str) -> Column:
    """The grouping key of an address: IPv4 /24, IPv6 /56; null for anything else. Only IPv6 goes to Python."""
    address = F.col(address) if isinstance(address, str) else address
    v4 = F.coalesce(address.rlike(IPV4), F.lit(False))
    return F.when(v4, F.concat(F.regexp_extract(address, IPV4, 1), F.lit("0/24"))).otherwise(_ipv6_network(F.when(~v4 & address.contains(":"), address)))

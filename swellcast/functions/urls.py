"""External URL filter as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: length limit and host ranges that never leave a private network -----
MAX_URL_LENGTH = 2048
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
PRIVATE_IPV4 = (
    r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.168\.|^192\.0\.[02]\."
    r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^2(?:2[4-9]|[345]\d)\."
)
PRIVATE_IPV6 = r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*)$"


def safe_url(url: Column) -> Column:
    """The URL without its fragment, or an empty string when it must not be shown."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(raw, r"^[^:/?#]+://([^/?#]*)", 1)
    host = F.lower(
        F.regexp_extract(authority, r"^(?:[^@]*@)?(?:\[([^\]]*)\]|([^:\[\]]*))(?::\d*)?$", 1)
    )
    named = F.lower(
        F.regexp_extract(authority, r"^(?:[^@]*@)?(?:\[([^\]]*)\]|([^:\[\]]*))(?::\d*)?$", 2)
    )
    host = F.when(host != "", host).otherwise(named)
    private = (
        host.isin("localhost", "0.0.0.0")
        | host.endswith(".local")
        | (host.rlike(IPV4) & host.rlike(PRIVATE_IPV4))
        | (host.contains(":") & host.rlike(PRIVATE_IPV6))
    )
    ok = (
        (F.length(raw) > 0)
        & (F.length(raw) <= MAX_URL_LENGTH)
        & scheme.isin("http", "https")
        & ~authority.contains("@")
        & (host != "")
        & ~private
    )
    # Scheme in lower case, as a parsed-and-rebuilt URL has it.
    rebuilt = F.concat(scheme, F.regexp_replace(F.regexp_replace(raw, "#.*$", ""), "^[^:]*", ""))
    return F.when(ok, rebuilt).otherwise(F.lit(""))

"""Is a URL or address inside the own network?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Loopback, private and link-local ranges; the private ones include the reserved and
# documentation blocks that the standard library counts as private.
_V4_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4_PATTERN = rf"^{_V4_OCTET}\.{_V4_OCTET}\.{_V4_OCTET}\.{_V4_OCTET}$"
INTERNAL_V4_PATTERN = (
    r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|192\.0\.0\.([0-8]|1[1-9]|[2-9]\d|1\d\d|2\d\d)$"
    r"|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|24\d\.|25[0-5]\.)"
)
INTERNAL_V6_PATTERN = r"^(::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|2001:db8:.*|100::.*)$"


def url_host(url: Column) -> Column:
    """Host part in lower case, without brackets; empty when there is none."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.translate(F.lower(F.trim(host)), "[]", "")


def host_class(host: Column) -> Column:
    """`internal` for localhost, *.local, loopback, private and link-local; else `external`."""
    internal = (
        (host == "localhost") | host.endswith(".local")
        | (host.rlike(V4_PATTERN) & host.rlike(INTERNAL_V4_PATTERN))
        | (host.contains(":") & host.rlike(INTERNAL_V6_PATTERN))
    )
    return F.when(F.coalesce(internal, F.lit(False)), "internal").otherwise("external")

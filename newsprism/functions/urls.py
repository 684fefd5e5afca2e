"""URL column functions (P1-P3). All are JVM-side regex expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Authority part of a URL: text after "//" up to "/", "?" or "#".  A scheme is
# optional, so "//host/x" works; anything without "//" yields ''.
NETLOC_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_netloc(url) -> Column:
    """Network location (user info, host and port kept), '' when absent."""
    return F.regexp_extract(_col(url), NETLOC_PATTERN, 1)


def url_base(url, keep: tuple[str, ...] = ()) -> Column:
    """Short source name of a URL.

    Strip every leading ``www.``, then repeatedly strip a trailing
    ``.xx``/``.xxx`` label, then one leading lower-case label.  ``keep``
    names endings (without the dot) that stop the trailing strip; by
    default none do, which is the effective behaviour of the studied code.
    """
    host = F.regexp_replace(url_netloc(url), r"^(www[.])+", "")
    stop = r"(?!(?:" + "|".join(keep) + r")(?:[.]|$))" if keep else ""
    host = F.regexp_replace(host, r"([.]" + stop + r"[a-z]{2,3})+$", "")
    return F.regexp_replace(host, r"^[a-z]+[.]", "")


def domain_ending(url) -> Column:
    """Everything after the first dot of the netloc ('' when there is no dot)."""
    return F.regexp_extract(url_netloc(url), r"[.](.+)$", 1)

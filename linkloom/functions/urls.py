"""URL taking-apart as column expressions.

``parse_url``/``try_parse_url`` follow ``java.net.URI``, which rejects hosts and
paths that links in the wild do contain.  The expressions here follow the
generic URL syntax with these rules:

* a URL without a scheme is relative; its first segment may not hold a colon;
* the authority starts after ``//`` and ends at the next ``/`` or ``?``;
* ``%`` must be followed by two hex digits in path, fragment and user info, and
  may only encode non-ASCII bytes in the host;
* a port is made of digits; control characters are refused.

Loops are possessive, so long or hostile input costs linear time and constant stack.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*+"
_HEX = r"[0-9A-Fa-f]{2}"
_END = r"(?=[/?#]|\z)"
_PATH = rf"(?:[^%?#]++|%{_HEX})*+"
# The host may escape non-ASCII bytes only; "%25" stands for itself.
_HOST_CHAR = rf"[A-Za-z0-9\-._~!$&'()*+,;=<>\"\[]++|[^\x00-\x7F]++|%25|%[89A-Fa-f][0-9A-Fa-f]"
_HOST_PORT = (
    # In brackets up to the last one, then the port ...
    rf"(?:\[(?:(?:{_HOST_CHAR}|:)*+\])++(?::[0-9]*+)?+"
    # ... or plain: the last colon starts the port, if there is any.
    rf"|(?!\[)(?:(?:(?:{_HOST_CHAR}|\])*+:)++[0-9]*+|(?:{_HOST_CHAR}|\])*+))"
)
_USER = rf"(?:(?:[A-Za-z0-9\-._~:!$&'()*+,;=]++|%{_HEX})*+@)*+"
_AUTHORITY = rf"{_USER}{_HOST_PORT}{_END}"

_VALID = (
    r"^(?![^#]*[\x00-\x1F\x7F])"
    rf"(?:{_SCHEME}:(?://{_AUTHORITY}{_PATH}|/(?!/){_PATH}|(?!/)[^?#]*+)"
    rf"|//(?!/){_AUTHORITY}{_PATH}"
    # Relative: no colon in the first segment.
    rf"|(?!//(?!/))(?:[^%:/?#]++|%{_HEX})*+{_END}{_PATH})"
    rf"(?:\?[^#]*+)?+(?:#(?:[^%]++|%{_HEX})*+)?+\z"
)
_SCHEME_PART = rf"^({_SCHEME}):"
# Without user info, brackets and port.
_HOST_PART = (
    rf"^(?:{_SCHEME}://|//(?!/))(?:[^/?#@]*+@)*+\[?+([^/?#]*?)\]?(?::[0-9]*+)?{_END}"
)
# What follows "scheme:" without a slash is opaque: neither host nor path.
_PATH_PART = rf"^(?:{_SCHEME}:(?://[^/?#]*+|(?=/)|[^?#]*+)|//(?!/)[^/?#]*+)?+([^?#]*+)"


class UrlParts(NamedTuple):
    """``ok`` is false where the text is no URL; the other parts are then unspecified."""

    ok: Column
    scheme: Column
    host: Column
    path: Column


def parse_url(url: Column) -> UrlParts:
    """Take a URL apart: validity, lower-case scheme, host name, decoded path.

    Each part is one pattern over the text itself, not built on another part: a
    filter is evaluated without sharing common sub-expressions.
    """
    raw_path = F.regexp_extract(url, _PATH_PART, 1)
    return UrlParts(
        ok=url.rlike(_VALID),
        scheme=F.lower(F.regexp_extract(url, _SCHEME_PART, 1)),
        host=F.regexp_extract(url, _HOST_PART, 1),
        # Form decoding would turn "+" into a space, which paths must keep.
        path=F.try_url_decode(F.replace(raw_path, F.lit("+"), F.lit("%2B"))),
    )


def url_ok(url: Column) -> Column:
    return parse_url(url).ok


def url_hostname(url: Column) -> Column:
    """Host without user info, port and IPv6 brackets; '' if none, NULL if no URL."""
    parts = parse_url(url)
    return F.when(parts.ok, parts.host)


def url_path(url: Column) -> Column:
    """Percent-decoded path; NULL if the text is no URL."""
    parts = parse_url(url)
    return F.when(parts.ok, parts.path)


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def trim_ext(name: Column) -> Column:
    """Cut from the last dot on: ``a.tar.gz`` -> ``a.tar``, ``.bashrc`` -> ``''``."""
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)
    return F.when(name.contains("."), stem).otherwise(name)

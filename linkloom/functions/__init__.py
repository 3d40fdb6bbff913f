"""Scalar column functions."""

from linkloom.functions.backoff import fibonacci_multiplier, fibonacci_numbers
from linkloom.functions.text import (
    first_line,
    is_blank,
    rfc1123,
    sanitize_title,
    title_or_href,
    trim_space,
)
from linkloom.functions.urls import (
    UrlParts,
    base_name,
    parse_url,
    trim_ext,
    url_hostname,
    url_ok,
    url_path,
)

__all__ = [
    "UrlParts",
    "base_name",
    "fibonacci_multiplier",
    "fibonacci_numbers",
    "first_line",
    "is_blank",
    "parse_url",
    "rfc1123",
    "sanitize_title",
    "title_or_href",
    "trim_ext",
    "trim_space",
    "url_hostname",
    "url_ok",
    "url_path",
]

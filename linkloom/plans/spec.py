"""Declarative job specs: feeds, ordered filters, intervals."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from linkloom.operators.item_filters import filter_titles
from linkloom.operators.link_filters import (
    Step,
    expand_short_links,
    filename_as_title,
    filter_domains,
    filter_url_regex,
)
from linkloom.operators.schedule import FETCH_INTERVAL, MAX_ATTEMPTS
from linkloom.operators.stores import CLEANUP_INTERVAL, CLEANUP_MAX_AGE, OUTPUT_MAX_AGE
from linkloom.operators.window_dedup import MAX_SEQUENCE_ROWS, drop_window_duplicates
from linkloom.sources.feeds import FEED_TYPES
from linkloom.workspace import local_rows

DEFAULT_WINDOW = 100

ITEM_FILTER_TYPES = ("title",)
LINK_FILTER_TYPES = ("domain", "duplicates", "expanduploadedlinks", "filenameastitle", "regex")

_UNITS = {
    "h": timedelta(hours=1),
    "m": timedelta(minutes=1),
    "s": timedelta(seconds=1),
    "ms": timedelta(milliseconds=1),
    "us": timedelta(microseconds=1),
    "µs": timedelta(microseconds=1),
}
_DURATION_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ms|us|µs|h|m|s)")


class SpecError(ValueError):
    """The spec asks for something that does not exist."""


def parse_duration(text: str | timedelta) -> timedelta:
    """``1h5m``, ``90s``, ``1.5h``."""
    if isinstance(text, timedelta):
        return text
    text = str(text).strip()
    if text == "0":
        return timedelta(0)
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    parts = _DURATION_PART.findall(body)
    if not parts or "".join(number + unit for number, unit in parts) != body:
        raise SpecError(f"not a duration: {text!r}")
    return sign * sum((float(n) * _UNITS[unit] for n, unit in parts), timedelta(0))


@dataclass(frozen=True)
class PipelineSpec:
    """What a job does.  Build it with :meth:`from_dict` or :meth:`from_file`."""

    fetch_interval: timedelta = FETCH_INTERVAL
    output_max_age: timedelta = OUTPUT_MAX_AGE
    cleanup_interval: timedelta = CLEANUP_INTERVAL
    cleanup_max_age: timedelta = CLEANUP_MAX_AGE
    max_attempts: int = MAX_ATTEMPTS
    feeds: tuple[dict[str, Any], ...] = ()
    item_filters: tuple[dict[str, Any], ...] = ()
    link_filters: tuple[dict[str, Any], ...] = ()
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> PipelineSpec:
        durations = {
            "fetchInterval": "fetch_interval",
            "feedOutputMaxAge": "output_max_age",
            "cleanupInterval": "cleanup_interval",
            "cleanupMaxAge": "cleanup_max_age",
        }
        values: dict[str, Any] = {
            name: parse_duration(raw[key]) for key, name in durations.items() if key in raw
        }
        if "maxAttempts" in raw:
            values["max_attempts"] = int(raw["maxAttempts"])

        feeds = []
        for feed in raw.get("feeds") or []:
            if feed.get("type") not in FEED_TYPES:
                raise SpecError(f"unknown feed type: {feed.get('type')}")
            own = parse_duration(feed.get("fetchInterval", "0"))
            interval = own or values.get("fetch_interval", FETCH_INTERVAL)
            feeds.append({**feed, "fetchInterval": interval})

        def filters(key: str, known: Sequence[str]) -> tuple[dict[str, Any], ...]:
            entries = tuple(dict(entry) for entry in raw.get(key) or [])
            for entry in entries:
                if entry.get("type") not in known:
                    raise SpecError(f"unsupported filter type in {key}: {entry.get('type')}")
            return entries

        used = {*durations, "maxAttempts", "feeds", "itemFilters", "linkFilters"}
        return cls(
            feeds=tuple(feeds),
            item_filters=filters("itemFilters", ITEM_FILTER_TYPES),
            link_filters=filters("linkFilters", LINK_FILTER_TYPES),
            extra={key: value for key, value in raw.items() if key not in used},
            **values,
        )

    @classmethod
    def from_file(cls, path: str) -> PipelineSpec:
        """JSON, or YAML where the optional yaml module is present."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        try:
            import yaml
        except ImportError as error:
            raise SpecError("YAML specs need the yaml module; use JSON instead") from error
        return cls.from_dict(yaml.safe_load(text) or {})


def item_chain(spec: PipelineSpec) -> list[Step]:
    """The item filters as steps for :func:`~linkloom.operators.link_filters.apply_chain`."""
    return [partial(filter_titles, titles=entry.get("titles") or []) for entry in spec.item_filters]


def link_chain(
    spec: PipelineSpec,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    lookups: DataFrame | None = None,
    max_sequence_rows: int = MAX_SEQUENCE_ROWS,
) -> list[Step]:
    """The link filters as steps, in the order of the spec.

    The order matters: a ``duplicates`` step remembers only what the steps before
    it let through, so nothing may be moved across it.
    """
    steps: list[Step] = []
    for entry in spec.link_filters:
        kind = entry["type"]
        if kind == "domain":
            steps.append(partial(filter_domains, domains=entry.get("domains") or []))
        elif kind == "duplicates":
            size = int(entry.get("size") or 0)
            steps.append(
                partial(
                    drop_window_duplicates,
                    size=size if size > 0 else DEFAULT_WINDOW,
                    order_by=order_by,
                    partition_by=partition_by,
                    max_sequence_rows=max_sequence_rows,
                )
            )
        elif kind == "regex":
            steps.append(partial(filter_url_regex, expressions=entry.get("exprs") or []))
        elif kind == "filenameastitle":
            steps.append(
                partial(filename_as_title, trim_extension=bool(entry.get("trimExt", False)))
            )
        elif kind == "expanduploadedlinks":
            if lookups is None:
                raise SpecError("expanduploadedlinks needs a table of lookups")
            steps.append(partial(expand_short_links, lookups=lookups))
    return steps


def feed_table(spark: SparkSession, spec: PipelineSpec) -> DataFrame:
    """The feeds to poll, with the interval of each."""
    schema = T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("fetch_interval", T.DayTimeIntervalType()),
        ]
    )
    rows = [(feed["type"], feed["url"], feed["fetchInterval"]) for feed in spec.feeds]
    return local_rows(spark, schema, rows)

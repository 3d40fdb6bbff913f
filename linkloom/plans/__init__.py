"""Whole jobs: a declarative spec of filters, and feeds-to-links end to end."""

from linkloom.plans.collect import collect_links
from linkloom.plans.documents import DocumentRun, collect_documents
from linkloom.plans.fetches import due_feeds, due_pages
from linkloom.plans.follow import FollowScans, follow_scans
from linkloom.plans.spec import PipelineSpec, SpecError, item_chain, link_chain, parse_duration

__all__ = [
    "DocumentRun",
    "FollowScans",
    "PipelineSpec",
    "SpecError",
    "collect_documents",
    "collect_links",
    "due_feeds",
    "due_pages",
    "follow_scans",
    "item_chain",
    "link_chain",
    "parse_duration",
]

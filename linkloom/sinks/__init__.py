"""Where results go: RSS output and the day-partitioned store tables."""

from linkloom.sinks.feed import feed_item_xml, output_feed, write_feed
from linkloom.sinks.publish import FeedDocument, publish_feed
from linkloom.sinks.tables import StoreTable

__all__ = ["FeedDocument", "StoreTable", "feed_item_xml", "output_feed", "publish_feed", "write_feed"]

"""Record schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("pub_date", T.TimestampType()),
    ]
)

LINK = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

STORED_ITEM = T.StructType(ITEM.fields + [T.StructField("added", T.TimestampType())])
STORED_LINK = T.StructType(LINK.fields + [T.StructField("added", T.TimestampType())])
# Pages that have been read for links.
SCANNED = T.StructType([T.StructField("url", T.StringType()), T.StructField("added", T.TimestampType())])

ATTEMPT_LOG = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

FETCH_RESULT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.BinaryType()),
    ]
)

LOOKUP = T.StructType(
    [
        T.StructField("status_url", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

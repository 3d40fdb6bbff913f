"""Secret scan with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.workspace import stage

from .common import text_of

#: kind -> (pattern, pattern of the value within a match, its least length, part).
#: Strong kinds are reported by themselves, weak ones only beside a complement.
STRONG = {
    "assign": (
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        "secret",
    ),
    "access": (r"AKIA[A-Z0-9]{14,}", r"^(.*)", 18, "id"),
    "hex": (r"[0-9a-f]{16,}", r"^(.*)", 16, "secret"),
}
WEAK = {
    "weak_id": (
        r"""(?i)(?:access_?key_?id|client_?id|account|user(?:name)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
        r"^(.*)",
        0,
        "id",
    ),
    "weak_secret": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}+", r"^(.*)", 32, "secret"),
    "endpoint": (
        r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+""",
        r"^(.*)",
        0,
        "place",
    ),
}
KINDS = {**STRONG, **WEAK}


def _spans(kind: str, found: str) -> Column:
    """Matches of a kind as structs, or null without any: number, gap before, length, value's length.

    The text between matches comes from splitting by the same pattern, so that gaps and
    lengths add up to offsets in code points.
    """
    pattern, value, _, _ = KINDS[kind]
    gaps = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(found))
    return F.when(
        F.size(found) > 0,
        F.transform(
            F.arrays_zip(F.col(found).alias("m"), gaps.alias("g")),
            lambda z, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                F.char_length(z["g"]).alias("gap"),
                F.char_length(z["m"]).alias("len"),
                F.char_length(F.regexp_extract(z["m"], value, 1)).alias("value"),
                (z["m"].rlike("[0-9]") & z["m"].rlike("[a-z]") & z["m"].rlike("[A-Z]")).alias("mixed"),
            ),
        ),
    )


def _kind_column(values: dict[str, object]) -> Column:
    pairs = [F.lit(v) for pair in values.items() for v in pair]
    return F.create_map(*pairs)[F.col("kind")]


def _bins(first: Column, last: Column, reach: int) -> Column:
    return F.explode(F.sequence(F.floor(first / reach), F.floor(last / reach)))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, reach: int = 200
) -> DataFrame:
    """Spans of secrets: ``doc_id, n_assign, n_access, n_hex, base_spans, spans``, a row per row.

    Strong kinds (a named value, an access identifier, a long hexadecimal run) are found
    by pattern and stay.  Weak kinds (an identifier by name, a long mixed token, an
    address of a service) are reported only where a complementary part lies within
    ``reach`` code points in the same text: identifiers with secrets and the other way
    round, addresses with either.  That is an interval join by text and position bin, so
    its work follows the number of spans, also in a long text with many of them.
    Weak tokens that overlap a strong span are part of it and not reported again.

    ``base_spans`` holds the strong ones and ``spans`` all as ``kind:start:end``, in the
    order of start and then kind, joined by commas; offsets count code points, the end is
    exclusive.  Null and empty texts have none.  Ids are passed on, null or repeated;
    other columns are not looked at; an empty table gives an empty result.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumns(
        {f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, (p, *_) in KINDS.items()}
    )
    found = raw.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.flatten(F.array_compact(F.array(*[_spans(k, f"m_{k}") for k in KINDS]))).alias("found"),
    )
    # From here on no text is needed: only rows, numbered once, and their matches.
    found = stage(found, "secret-matches")
    line = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    spans = (
        found.select("row", F.explode("found").alias("f"))
        .select("row", "f.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(line))
        .withColumn("start", F.col("end") - F.col("len"))
        .filter(F.col("value") >= _kind_column({k: v[2] for k, v in KINDS.items()}))
        .filter((F.col("kind") != "weak_secret") | F.col("mixed"))
        .select(
            "row",
            "kind",
            "start",
            "end",
            _kind_column({k: v[3] for k, v in KINDS.items()}).alias("part"),
            F.col("kind").isin(*STRONG).alias("strong"),
        )
    )
    spans = stage(spans, "secret-spans")
    near = spans.select(
        "row", "part", "start", "end", _bins(F.col("start"), F.col("end"), reach).alias("bin")
    ).alias("near")
    strong_bins = spans.filter("strong").select(
        "row", "start", "end", _bins(F.col("start"), F.col("end"), reach).alias("bin")
    ).alias("own")
    weak = spans.filter("NOT strong").withColumn(
        "bin", _bins(F.col("start") - reach, F.col("end") + reach, reach)
    ).alias("weak")
    same = lambda other: (F.col("weak.row") == F.col(f"{other}.row")) & (
        F.col("weak.bin") == F.col(f"{other}.bin")
    )
    close = (F.col("near.start") <= F.col("weak.end") + reach) & (
        F.col("near.end") >= F.col("weak.start") - reach
    )
    complement = (F.col("near.part") != F.col("weak.part")) & (
        (F.col("weak.part") == "place") | (F.col("near.part") != "place")
    )
    overlap = (F.col("own.start") < F.col("weak.end")) & (F.col("own.end") > F.col("weak.start"))
    keys = ["row", "kind", "start", "end"]
    linked = weak.join(near, same("near") & close & complement, "left_semi").select(*keys).distinct()
    hidden = weak.join(strong_bins, same("own") & overlap, "left_semi").select(*keys).distinct()
    reported = linked.join(hidden, keys, "left_anti")
    order = _kind_column({k: i for i, k in enumerate(KINDS)})
    text = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    lists = (
        spans.filter("strong")
        .select(*keys, F.lit(True).alias("strong"))
        .unionAll(reported.select(*keys, F.lit(False).alias("strong")))
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("start", order.alias("o"), "kind", text.alias("s"), "strong"))
            ).alias("all")
        )
    )
    base = F.filter("all", lambda x: x["strong"])
    names = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x["s"]), ","), F.lit(""))
    count = lambda kind: F.coalesce(
        F.size(F.filter("all", lambda x: x["kind"] == kind)), F.lit(0)
    ).cast("long")
    return found.join(lists, "row", "left").select(
        "doc_id",
        *[
            F.when(F.col("all").isNull(), F.lit(0)).otherwise(count(k)).cast("long").alias(f"n_{k}")
            for k in STRONG
        ],
        names(base).alias("base_spans"),
        names(F.col("all")).alias("spans"),
    )

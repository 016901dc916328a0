"""Not-modified revisits of a web archive, resolved by an as-of join on the canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Headers that a 304 reply may renew in the stored response
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change the page
TRACKING = ("fbclid", "gclid", "ref")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and last slash go; host is lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/$", "")
    asked = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&", -1)
    name = lambda x: F.lower(F.regexp_extract(x, r"^([^=]*)", 1))
    held = F.array_sort(F.filter(asked, lambda x: (x != "") & ~name(x).startswith("utm_") & ~name(x).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(held) > 0, F.concat(F.lit("?"), F.array_join(held, "&"))).otherwise(""))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve_revisits(responses: DataFrame, revisits: DataFrame, slot_seconds: int = 86_400) -> DataFrame:
    """Each revisit with the full response it stands for.

    ``responses`` and ``revisits`` have ``record_id, url, ts`` (seconds), ``etag, last_modified, payload_digest`` and
    ``headers`` (a map, lower-case names); further columns are ignored.  The candidate is the latest response of the same
    canonical URL whose ``ts`` is smaller; of several at one second the one with the largest ``record_id``.  ``status`` is

    ``resolved``: the first validator that both carry agrees, in the order ETag (weak tags compare as strong ones), payload
    digest, Last-Modified; ``mismatch``: it differs; ``no_validator``: they share none; ``no_response``: no earlier one.

    A resolved row has ``refers_to`` and the response's headers, where the permitted ones of the revisit replace or join
    its own; other rows have the revisit's own headers and no ``refers_to``.  NULL url or ts: ``no_response``.  Repeated
    rows give repeated results.  Result: ``record_id, target_url, ts, refers_to, status, headers``.

    A URL with very many captures is split into time slots: within a slot a window finds the response, across slots only
    each slot's last response is carried on.
    """
    validators = ("record_id", "etag", "payload_digest", "last_modified", "headers")
    full = responses.select(canonical_url(F.col("url")).alias("target_url"), F.col("ts").cast("long").alias("ts"),
                            F.struct(*validators).alias("response")).filter("target_url is not null and ts is not null")
    asked = revisits.select(canonical_url(F.col("url")).alias("target_url"), F.col("ts").cast("long").alias("ts"), F.struct(*validators).alias("revisit"))
    # one row per URL and second on either side, so that repeats meet before any window
    latest = F.max_by("response", F.col("response.record_id")).alias("response")
    points = full.groupBy("target_url", "ts").agg(latest)
    wanted = asked.filter("target_url is not null and ts is not null").groupBy("target_url", "ts").agg(F.lit(None).cast(points.schema["response"].dataType).alias("response"))
    events = (points.unionByName(wanted).groupBy("target_url", "ts").agg(F.max_by("response", F.col("response").isNotNull()).alias("response"))
              .withColumn("slot", F.floor(F.col("ts") / slot_seconds)))
    ends = events.groupBy("target_url", "slot").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.col("ts"))).alias("slot_last"))
    over_slots = Window.partitionBy("target_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("target_url", "slot", F.last("slot_last", ignorenulls=True).over(over_slots).alias("carried"))
    within = Window.partitionBy("target_url", "slot").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    prior = (events.withColumn("inside", F.last("response", ignorenulls=True).over(within)).join(carried, ["target_url", "slot"])
             .select(F.col("target_url").alias("at_url"), F.col("ts").alias("at_ts"), F.coalesce("inside", "carried").alias("prior")))
    found = asked.join(prior, (F.col("target_url") == F.col("at_url")) & (F.col("ts") == F.col("at_ts")), "left")

    r, p = (lambda c: F.col(f"revisit.{c}")), (lambda c: F.col(f"prior.{c}"))
    status = F.when(F.col("prior").isNull(), "no_response")
    for name, same in (("etag", _strong(r("etag")) == _strong(p("etag"))), ("payload_digest", r("payload_digest") == p("payload_digest")),
                       ("last_modified", r("last_modified") == p("last_modified"))):
        shared = r(name).isNotNull() & p(name).isNotNull()
        status = status.when(shared & same, "resolved").when(shared, "mismatch")
    named = found.withColumn("status", status.otherwise("no_validator"))
    renewed = F.map_filter(r("headers"), lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(p("headers"), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(renewed, F.create_map().cast("map<string,string>"))), k))
    merged = F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(renewed, F.create_map().cast("map<string,string>")))
    resolved = F.col("status") == "resolved"
    return named.select(r("record_id").alias("record_id"), "target_url", "ts", F.when(resolved, p("record_id")).alias("refers_to"),
                        "status", F.when(resolved, merged).otherwise(r("headers")).alias("headers"))

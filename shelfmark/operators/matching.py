"""Patterns of events and origins, and the conditions of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.values import event_kind
from shelfmark.session import small


def event_matches(patterns: Column, name: Column) -> Column:
    """Whether any pattern covers an event name: 'x:*' as a beginning, all others as a whole.

    Letter case, white space around and a missing 's3:' before them make no difference.
    """
    full = lambda c: F.concat(F.lit("s3:"), event_kind(c))
    named = full(name)

    def covers(p: Column) -> Column:
        whole = full(p)
        return F.when(F.trim(p) == "*", False).when(whole.endswith(":*"), F.startswith(named, F.left(whole, F.length(whole) - 1))).otherwise(whole == named)

    return F.exists(patterns, covers)


def deliveries(events: DataFrame, webhooks: DataFrame, most: int = 50_000) -> DataFrame:
    """Each event once for each webhook of its bucket whose patterns, prefix and suffix it meets.

    webhooks has bucket, id, url, events and filter(prefix, suffix). They are counted, and sent to the
    tasks if they are few.
    """
    hooks = small(webhooks.select("bucket", F.col("id").alias("webhook_id"), "url", F.col("events").alias("_events"), F.col("filter.prefix").alias("_prefix"), F.col("filter.suffix").alias("_suffix")), most)
    key = F.col("object_key")
    fits = event_matches(F.col("_events"), F.col("event_name")) & F.coalesce(F.startswith(key, F.col("_prefix")), F.lit(True)) & F.coalesce(F.endswith(key, F.col("_suffix")), F.lit(True))
    return events.join(hooks, "bucket").filter(fits).drop("_events", "_prefix", "_suffix")


def origin_matches(patterns: Column, origin: Column) -> Column:
    """Whether any pattern covers an origin: '*' all, one with a star by what is around it, others as a whole."""

    def covers(p: Column) -> Column:
        star = F.instr(p, "*")
        left, right = F.left(p, star - 1), F.substring(p, star + 1, F.length(p))
        around = F.startswith(origin, left) & F.endswith(origin, right) & (F.length(origin) >= F.length(p) - 1)
        return F.when(p == "*", True).when(star > 0, around).otherwise(p == origin)

    return F.exists(patterns, covers)


def first_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Each (origin, method) request with the first rule that allows it, in the order of rules' position; null if none does.

    rules has bucket, position, allowed_origins and allowed_methods; methods match in any case.
    """
    per = rules.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("position", "allowed_origins", "allowed_methods"))).alias("_rules"))
    fits = F.filter("_rules", lambda r: origin_matches(r["allowed_origins"], F.col("origin")) & F.exists(r["allowed_methods"], lambda m: (m == "*") | (F.lower(m) == F.lower(F.col("method")))))
    return requests.join(small(per), "bucket", "left").withColumn("rule", F.get(fits, F.lit(0))["position"]).drop("_rules")


def condition(etag: Column, modified: Column, if_match: Column, if_none_match: Column, if_modified_since: Column, if_unmodified_since: Column, copying: bool = False) -> Column:
    """What a conditional request comes to: ok, not_modified or failed; conditions that are null are not asked.

    They are tried in the order given. When copying, what is not modified has failed.
    """
    unmodified = "failed" if copying else "not_modified"
    return (
        F.when(if_match.isNotNull() & ~etag.eqNullSafe(if_match), "failed")
        .when(if_none_match.isNotNull() & etag.eqNullSafe(if_none_match), unmodified)
        .when(if_modified_since.isNotNull() & (modified <= if_modified_since), unmodified)
        .when(if_unmodified_since.isNotNull() & (modified > if_unmodified_since), "failed")
        .otherwise("ok")
    )


def digest_mismatch(computed: dict[str, Column], claimed: dict[str, Column]) -> Column:
    """The name of the first digest that a client gave and that is another one, or null; what it did not give is not checked."""
    out = F.lit(None).cast("string")
    for name in reversed(list(computed)):
        if name in claimed:
            out = F.when(claimed[name].isNotNull() & ~claimed[name].eqNullSafe(computed[name]), name).otherwise(out)
    return out

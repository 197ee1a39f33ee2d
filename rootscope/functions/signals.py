"""Signal taxonomy: category, harmful direction and groups, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first category whose substring or whole token a lower-cased metric name has; order matters.
RULES = [
    ("self_time", ["self_time", "self-time", "selftime"], []),
    ("error_origin", ["error_origin"], []),
    ("runtime", ["garbage", "goroutine", "thread", "pause"], ["gc"]),
    ("latency", ["latency", "duration", "response_time"], ["rt"]),
    ("errors", ["error", "fail", "exception"], ["5xx"]),
    ("logs", [], ["log", "logs"]),
    ("cpu", ["cpu", "throttl"], []),
    ("memory", ["memory", "heap", "oom"], ["mem", "rss"]),
    ("disk", ["disk", "filesystem"], ["fs", "io", "iops"]),
    ("connections", ["socket", "connection", "file_descriptor"], ["conn", "conns", "fd", "fds", "pool"]),
    ("network", ["network", "packet", "retrans", "receive", "transmit", "bytes_sent", "bytes_recv"], ["net"]),
    ("traffic", ["request", "throughput", "workload"], ["rate", "qps", "rps", "load", "count", "total", "calls"]),
]
#: Fixed values.
BOTH_WAYS = ["traffic", "network", "other"]
LOCAL = ["cpu", "memory", "disk", "network", "connections", "runtime", "self_time", "error_origin"]
GROUPS = {
    "resource": ["cpu", "memory", "disk", "network", "connections", "runtime"],
    "latency": ["latency"], "errors": ["errors"], "traffic": ["traffic"], "logs": ["logs"],
    "trace_local": ["self_time", "error_origin"],
}
CATEGORIES = [r[0] for r in RULES] + ["other"]


def category(name: Column) -> Column:
    low = F.lower(name)
    tokens = F.split(low, "[^a-z0-9]")
    out = F
    for label, has, whole in RULES:
        test = F.lit(False)
        for x in has:
            test = test | low.contains(x)
        if whole:
            test = test | F.arrays_overlap(tokens, F.array(*map(F.lit, whole)))
        out = out.when(test, label)
    return out.otherwise("other")


def direction(category_: Column) -> Column:
    return F.when(category_.isin(BOTH_WAYS), "both").otherwise("up")


def harmful(z: Column, direction_: Column) -> Column:
    """The deviation in the harmful direction."""
    return (
        F.when(direction_ == "up", F.greatest(z, F.lit(0.0)))
        .when(direction_ == "down", F.greatest(-z, F.lit(0.0)))
        .otherwise(F.abs(z))
    )


def is_local(category_: Column) -> Column:
    return category_.isin(LOCAL)


def is_host_scoped(metric: Column) -> Column:
    return metric.startswith("system.") | metric.startswith("host.") | metric.startswith("node_")


def group(category_: Column) -> Column:
    out = F
    for name, members in GROUPS.items():
        out = out.when(category_.isin(members), name)
    return out.otherwise("other")


def parse_category(name: Column) -> Column:
    """The category's name; an unknown one is an error."""
    return F.when(name.isin(CATEGORIES), name).otherwise(F.raise_error(F.concat(F.lit("unknown category "), name)))

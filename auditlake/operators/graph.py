"""Data-flow graphs as (nodes, edges) tables: reachability risk as of a time, failure buckets, proof states.

nodes: graph_id, node_id, target_var. edges: graph_id, edge_no, source_id, sink_id,
source_type, sink_type, sanitizer_type, guarded_target, invalid_at (seconds).
graphs: graph_id, is_complete, parse_error, created_at (seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources.shared import written


def valid_sanitizer(sink: Column, sanitizer: Column) -> Column:
    out = F.lit(False)
    for name, allowed in fixed.VALID_SANITIZERS.items():
        out = out | ((sink == name) & sanitizer.isin(allowed))
    return F.coalesce(out, F.lit(False))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def supported_sink(x: Column) -> Column:
    return F.coalesce(x.isin(*fixed.VALID_SANITIZERS), F.lit(False))


def placed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with whether both their ends exist, and the sink's target."""
    src = nodes.select("graph_id", F.col("node_id").alias("source_id"), F.lit(True).alias("has_source"))
    dst = nodes.select("graph_id", F.col("node_id").alias("sink_id"), F.lit(True).alias("has_sink"), "target_var")
    both = edges.join(src, ["graph_id", "source_id"], "left").join(dst, ["graph_id", "sink_id"], "left")
    target = T.filled("guarded_target") & F.coalesce(F.col("guarded_target") == F.col("target_var"), F.lit(False))
    return both.withColumn("placed", F.coalesce(F.col("has_source") & F.col("has_sink"), F.lit(False))).withColumn(
        "proven", valid_sanitizer(F.col("sink_type"), F.col("sanitizer_type")) & target
    )


def reachability(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(graph_id, risk): low only for complete graphs with live edges all of whose untrusted ones are proven; else high."""
    return _risk(graphs, placed_edges(edges, nodes), as_of)


def _risk(graphs: DataFrame, placed: DataFrame, as_of: Column | None = None) -> DataFrame:
    at = as_of if as_of is not None else F.col("created_at")
    joined = placed.join(graphs.select("graph_id", at.alias("at")), "graph_id")
    limit = F.col("invalid_at")
    broken = ~supported_sink(F.col("sink_type")) | ~F.col("placed") | (limit.isNotNull() & ~finite(limit))
    live = limit.isNull() | (finite(limit) & (limit > F.col("at")))
    found = joined.groupBy("graph_id").agg(
        F.bool_or(broken).alias("broken"), F.count_if(live).alias("live"), F.bool_or(live & (F.col("source_type") == "UNTRUSTED_INPUT") & ~F.col("proven")).alias("open")
    )
    safe = F.col("is_complete") & F.col("parse_error").isNull() & finite(F.col("created_at")) & finite(at) & ~F.col("broken") & (F.col("live") > 0) & ~F.col("open")
    return graphs.join(found, "graph_id", "left").select("graph_id", F.when(F.coalesce(safe, F.lit(False)), fixed.LOW_RISK).otherwise(fixed.HIGH_RISK).alias("risk"))


def rejected(risks: DataFrame, limit: float = fixed.RISK_LIMIT) -> DataFrame:
    return risks.filter(F.col("risk") >= limit)


def failure_buckets(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, bucket, required_sanitizer, found_sanitizer, target_var, guarded_target) of failed attempts.

    graphs also has logic_error, strict_fail and anchor_match. The first bucket of
    the strict order holds; the edge that is shown is the first open one by edge_no.
    """
    e = placed_edges(edges, nodes)
    sink, untracked = supported_sink(F.col("sink_type")), F.col("source_type") == "UNKNOWN_ORIGIN"
    open_edge = sink & (F.col("source_type") == "UNTRUSTED_INPUT") & ~F.col("proven")
    shown = F.struct("edge_no", "sink_type", "sanitizer_type", "guarded_target", "target_var", valid_sanitizer(F.col("sink_type"), F.col("sanitizer_type")).alias("fits"))
    found = e.groupBy("graph_id").agg(
        F.count_if(sink).alias("sinks"), F.count_if(sink & ~F.coalesce(untracked, F.lit(False))).alias("tracked"), F.min(F.when(open_edge, shown)).alias("open"), F.min(F.when(sink, shown)).alias("first")
    )
    some_nodes = nodes.select("graph_id").distinct().withColumn("has_nodes", F.lit(True))
    all_ = graphs.join(found, "graph_id", "left").join(some_nodes, "graph_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    sinks = F.coalesce(F.col("sinks"), F.lit(0))
    bucket = (
        F.when(~F.col("is_complete") & ~yes(F.col("has_nodes")), "B_UNSUPPORTED_SYNTAX")
        .when(yes(F.col("logic_error")), "B_LOGIC_ERROR")
        .when(yes(F.col("strict_fail")) | ~F.coalesce(F.col("anchor_match"), F.lit(True)), "B_ANCHOR_UNMATCHED")
        .when((sinks > 0) & (F.col("tracked") == 0), "B_SOURCE_MISSING")
        .when(sinks == 0, "B_SINK_MISSING")
        .when(F.col("open").isNotNull(), F.when(F.col("open.fits"), "B_SANITIZER_TARGET_MISMATCH").otherwise("B_SANITIZER_MISMATCH"))
        .otherwise("B_LOGIC_ERROR")
    )
    required = F.create_map(*(F.lit(x) for pair in fixed.REQUIRED_SANITIZER.items() for x in pair))
    out = all_.withColumn("bucket", bucket)
    detail = F.when(F.col("bucket").startswith("B_SANITIZER"), F.col("open")).when(F.col("bucket") == "B_LOGIC_ERROR", F.when(~yes(F.col("logic_error")), F.col("first")))
    out = out.withColumn("d", detail)
    return out.select(
        "graph_id", "bucket", F.when(F.col("bucket").startswith("B_SANITIZER"), required[F.col("d.sink_type")]).alias("required_sanitizer"), F.col("d.sanitizer_type").alias("found_sanitizer"),
        F.col("d.target_var").alias("target_var"), F.col("d.guarded_target").alias("guarded_target"),
    )


def extraction_buckets(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, bucket, proof_state, acceptance): how far an extracted graph proves its snippet. nodes also has kind."""
    e = written(placed_edges(edges, nodes), "placed-edges")
    untrusted = F.col("source_type") == "UNTRUSTED_INPUT"
    kind = F.when(~T.filled("sanitizer_type"), "missing_sanitizer").when(~F.col("proven"), "wrong_sanitizer")
    found = e.groupBy("graph_id").agg(F.count("*").alias("edges"), F.min(F.when(untrusted & kind.isNotNull(), F.struct("edge_no", kind.alias("kind")))).alias("first"))
    sources = nodes.filter("kind = 'source'").select("graph_id").distinct().withColumn("has_source", F.lit(True))
    all_ = graphs.join(found, "graph_id", "left").join(sources, "graph_id", "left").join(_risk(graphs, e), "graph_id")
    bucket = (
        F.when(~F.col("is_complete") | F.col("parse_error").isNotNull(), "unsupported_syntax")
        .when(F.col("has_source").isNull(), "missing_source")
        .when(F.coalesce(F.col("edges"), F.lit(0)) == 0, "missing_sink")
        .when(F.col("risk") < fixed.RISK_LIMIT, "guarded_or_safe")
        .otherwise(F.coalesce("first.kind", F.lit("graph_high_risk")))
    )
    state = F.when(F.col("bucket") == "guarded_or_safe", "proven_safe").when(F.col("bucket").isin("missing_sanitizer", "wrong_sanitizer", "graph_high_risk"), "proven_unsafe").otherwise("unsupported_or_unproven")
    return all_.withColumn("bucket", bucket).withColumn("proof_state", state).select(
        "graph_id", "bucket", "proof_state", F.when(F.col("proof_state") == "proven_unsafe", 0.95).otherwise(0.0).alias("acceptance")
    )


def sample_outcomes(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, complete, has_signatures, probability): what an extracted graph says of its sample.

    0 for graphs that are not whole, 0.05 for those without edges and those proven safe, 0.95 for the others.
    """
    some = edges.select("graph_id").distinct().withColumn("edged", F.lit(True))
    all_ = graphs.join(some, "graph_id", "left").join(reachability(graphs, nodes, edges), "graph_id")
    complete = F.col("is_complete") & F.col("parse_error").isNull()
    signed = complete & F.coalesce("edged", F.lit(False))
    return all_.select(
        "graph_id", complete.alias("complete"), signed.alias("has_signatures"),
        F.when(~complete, 0.0).when(~signed | (F.col("risk") < fixed.RISK_LIMIT), fixed.LOW_RISK).otherwise(0.95).alias("probability"),
    )

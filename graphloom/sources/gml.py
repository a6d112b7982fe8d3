"""One GML file of a graph, written in parts and joined with its header and footer, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import numeric_id

_NODE = r'^  node \[ id (\d+) label "([^"]*)" type "([^"]*)" \]$'
_EDGE = r'^  edge \[ source (\d+) target (\d+) label "([^"]*)" \]$'


def gml_body(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(at, value): a line for each node (Id, Label, Type) and edge (Source, Target, Label), nodes first; ids are their numbers."""
    quoted = lambda c: F.translate(F.coalesce(c, F.lit("")), '"\n\r', "'  ")
    node = F.format_string('  node [ id %d label "%s" type "%s" ]', numeric_id(F.col("Id")), quoted("Label"), quoted("Type"))
    edge = F.format_string('  edge [ source %d target %d label "%s" ]', numeric_id(F.col("Source")), numeric_id(F.col("Target")), quoted("Label"))
    return nodes.select(F.lit(0).alias("at"), node.alias("value")).unionByName(edges.select(F.lit(1).alias("at"), edge.alias("value")))


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write one file that a GML reader opens, in place of what is at ``path``.

    Tasks write the parts, nodes before edges, beside the path; the parts are then copied to one file as streams, since
    the format has one, and that takes its name once it is whole.
    """
    spark = nodes.sparkSession
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop
    beside = f"{path}-{uuid.uuid4().hex}"
    parts, whole, target = (hadoop.fs.Path(p) for p in (beside, f"{beside}.gml", path))
    files = parts.getFileSystem(conf)
    try:
        gml_body(nodes, edges).repartitionByRange("at", "value").sortWithinPartitions("at", "value").select("value").write.text(beside)
        out = files.create(whole, True)
        line = lambda text: out.write(bytearray(text.encode()))
        line("graph [\n  directed 1\n")
        for part in sorted((f.getPath() for f in files.listStatus(parts) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            read = files.open(part)
            hadoop.io.IOUtils.copyBytes(read, out, conf, False)
            read.close()
        line("]\n")
        out.close()
        files.delete(target, True)
        if not files.rename(whole, target):
            raise OSError(f"cannot rename to {path}")
    finally:
        files.delete(parts, True)
        files.delete(whole, True)


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of such a file: (id, label, type) and (source, target, label)."""
    lines = spark.read.text(path)
    part = lambda pattern, k: F.regexp_extract("value", pattern, k)
    nodes = lines.where(F.col("value").rlike(_NODE)).select(part(_NODE, 1).cast("long").alias("id"), part(_NODE, 2).alias("label"), part(_NODE, 3).alias("type"))
    edges = lines.where(F.col("value").rlike(_EDGE)).select(part(_EDGE, 1).cast("long").alias("source"), part(_EDGE, 2).cast("long").alias("target"), part(_EDGE, 3).alias("label"))
    return nodes, edges

"""Sinks: node-link JSON, graph XML, reports, and the graph tables themselves."""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet import schema as S
from ledgernet import vocabulary as V
from ledgernet.functions.amounts import finite
from ledgernet.graph import SpendGraph

_NODE_FIELDS = [
    "original_id", "nome", "sigla", "municipio", "uf", "documento", "tipo_documento",
    "numero", "descricao", "valor", "data",
]


def snapshot_nodes(vertices: DataFrame) -> DataFrame:
    """Nodes of the node-link form; lineage columns only where the graph has them."""
    lineage = [c for c in S.LINEAGE if c in vertices.columns]
    return vertices.select(
        "id",
        F.col("node_type").alias("type"),
        *[finite(F.col(c)).alias(c) if c == "valor" else F.col(c) for c in _NODE_FIELDS],
        *lineage,
    )


def snapshot_links(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.col("edge_type").alias("type"),
        finite(F.col("valor")).alias("valor"),
    )


#: Graph files repeat the names of fields and the beginnings of ids in every element.
_COMPRESSION = "gzip"


def write_node_link(graph: SpendGraph, path: str) -> None:
    """Two JSON datasets, ``nodes`` and ``links``, compressed; null fields are left out."""
    snapshot_nodes(graph.vertices).write.mode("overwrite").json(f"{path}/nodes", compression=_COMPRESSION)
    snapshot_links(graph.edges).write.mode("overwrite").json(f"{path}/links", compression=_COMPRESSION)


#: Of a tenth more bytes than the default level of gzip, in a third of its time.
_QUICK = {"zlib.compress.level": "THREE"}

_GRAPHML = "http://graphml.graphdrawing.org/xmlns"
_KINDS = {T.DoubleType(): "double"}


#: Characters that do not stand for themselves in the files.
_NEEDS_ESCAPE = r'[\x00-\x1F&<>"\uFFFE\uFFFF]'


def _escaped(text: Column) -> Column:
    """Text as it stands in XML, also between quotation marks; characters XML has no place for are dropped."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _element(tag: str, attributes: dict[str, str], data: list[str]) -> Column:
    """A node or edge element with a data child for each column that is not null.

    Few rows hold a character that has to be escaped: one look at all texts of a row tells.
    """

    def written(escaped: Callable[[Column], Column]) -> Column:
        head = [part for name, column in attributes.items() for part in (F.lit(f' {name}="'), escaped(F.col(column)), F.lit('"'))]
        children = [
            F.coalesce(F.concat(F.lit(f'<data key="{c}">'), escaped(F.col(c).cast("string")), F.lit("</data>")), F.lit(""))
            for c in data
        ]
        return F.concat(F.lit(f"<{tag}"), *head, F.lit(">"), *children, F.lit(f"</{tag}>"))

    texts = F.concat_ws("", *[F.col(c).cast("string") for c in (*attributes.values(), *data)])
    return F.when(texts.rlike(_NEEDS_ESCAPE), written(_escaped)).otherwise(written(lambda text: text)).alias("value")


def _documents(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of each partition between the opening and the end of a document."""
    opening = ['<?xml version="1.0" encoding="UTF-8"?>', f'<graphml xmlns="{_GRAPHML}">', *keys, '<graph edgedefault="directed">']
    ending = ["</graph>", "</graphml>"]

    def run(batches):
        started = False
        for batch in batches:
            if not started:
                yield pa.record_batch([pa.array(opening)], ["value"])
                started = True
            yield batch
        if started:
            yield pa.record_batch([pa.array(ending)], ["value"])

    return lines.mapInArrow(run, "value string")


def write_graph_xml(graph: SpendGraph, path: str) -> None:
    """GraphML: every part file is a document of directed edges or of nodes, with typed keys.

    Together the files of ``nodes`` and ``edges`` are the graph. They are compressed.
    """
    writers = {
        "nodes": ("node", snapshot_nodes(graph.vertices), {"id": "id"}),
        "edges": ("edge", snapshot_links(graph.edges), {"source": "source", "target": "target"}),
    }
    for name, (tag, rows, attributes) in writers.items():
        data = [f for f in rows.schema.fields if f.name not in attributes.values()]
        keys = [
            f'<key id="{f.name}" for="{tag}" attr.name="{f.name}" attr.type="{_KINDS.get(f.dataType, "string")}"/>' for f in data
        ]
        lines = rows.select(_element(tag, attributes, [f.name for f in data]))
        _documents(lines, keys).write.mode("overwrite").options(**_QUICK).text(f"{path}/{name}", compression=_COMPRESSION)


def read_graph_xml(spark: SparkSession, path: str, tag: str, attributes: list[str], keys: list[str]) -> DataFrame:
    """The elements of a folder of ``write_graph_xml``: ``(<attributes>..., <keys>..., children)``.

    ``keys`` name the data children whose text is wanted, null where there is none; ``children`` counts
    all of them. The files have an element a line. Most are plain: nothing in them is escaped, so the marks
    between the texts cannot be taken for text, and whole batches are cut apart at them. The others
    go to an XML parser.
    """
    text = r'[^\x00-\x1F&<>"]*'
    names = "".join(f' {name}="{text}"' for name in attributes)
    plain_line = f'^<{tag}{names}>(?:<data key="{text}">{text}</data>)*</{tag}>$'
    columns = [*attributes, *keys, "children"]

    def cut(lines):
        """Plain elements: between quotation marks stand attributes, then keys, each followed by its text."""
        pieces = pc.split_pattern(lines, '"')
        flat, bounds = pieces.flatten(), pieces.offsets.to_numpy()
        start, before = bounds[:-1] - bounds[0], 2 * len(attributes)
        children = (np.diff(bounds) - 1 - before) // 2
        owner = np.repeat(np.arange(len(lines)), children)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(children) - children, children)
        at = start[owner] + before + 1 + 2 * nth
        named = flat.take(pa.array(at)).dictionary_encode()
        codes, known = named.indices.to_numpy(), named.dictionary.to_pylist()
        found = [flat.take(pa.array(start + 2 * i + 1)) for i in range(len(attributes))]
        for key in keys:
            hits = np.flatnonzero(codes == known.index(key)) if key in known else np.zeros(0, np.int64)
            until = pc.list_element(pc.split_pattern(flat.take(pa.array(at[hits] + 1)), "<", max_splits=1), 0)
            place = np.full(len(lines), -1)
            place[owner[hits]] = np.arange(len(hits))
            found.append(pc.utf8_slice_codeunits(until, 1).take(pa.array(place, mask=place < 0)))
        return [*found, pa.array(children, pa.int64())]

    def parsed(lines):
        rows = []
        for line in lines.to_pylist():
            element = ElementTree.fromstring(line)
            data = element.findall("data")
            texts = {child.get("key"): child.text or "" for child in data}
            rows.append([*map(element.get, attributes), *map(texts.get, keys), len(data)])
        kinds = [pa.string()] * (len(columns) - 1) + [pa.int64()]
        return [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]

    def run(batches):
        for batch in batches:
            lines = batch.column(0)
            lines = lines.filter(pc.starts_with(lines, f"<{tag} "))
            plain = pc.match_substring_regex(lines, plain_line)
            for part, read in ((lines.filter(plain), cut), (lines.filter(pc.invert(plain)), parsed)):
                if len(part):
                    yield pa.record_batch(read(part), columns)

    schema = ", ".join(f"`{name}` string" for name in columns[:-1]) + ", children long"
    return spark.read.text(path).mapInArrow(run, schema)


def write_report(summary: DataFrame, documents: DataFrame, path: str) -> None:
    """Summary and anomaly documents as JSON datasets, anomalies by detector."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    documents.write.mode("overwrite").partitionBy("detector").json(f"{path}/anomalies")


def write_graph(graph: SpendGraph, path: str) -> None:
    """Graph tables as Parquet, split by node and edge type so that type filters skip files."""
    graph.vertices.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
    if graph.commitments is not None:
        columns = ["empenho_id", "orgao_id", "fornecedor_id", "valor_empenhado"]
        graph.commitments.select(*columns).write.mode("overwrite").parquet(f"{path}/commitments")


def read_graph(spark: SparkSession, path: str, unique_commitments: bool = True) -> SpendGraph:
    """A graph written by ``write_graph``."""
    vertices = spark.read.schema(S.VERTICES).parquet(f"{path}/vertices").select(*S.VERTICES.names)
    edges = spark.read.schema(S.EDGES).parquet(f"{path}/edges").select(*S.EDGES.names)
    commitments = spark.read.parquet(f"{path}/commitments") if unique_commitments else None
    return SpendGraph(vertices, edges, end_types=V.END_TYPES, commitments=commitments)

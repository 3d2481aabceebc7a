"""A store of property graphs with all-or-nothing loads, as a Spark data source.

A load writes batches into files of its own, one folder a build; only after every task has ended and the counts agree does
the dataset's manifest name that build, in one rename. A load that fails leaves the manifest, and so the old graph, as it
was. Readers see the build that the manifest names. One load of a dataset runs at a time.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.operators.graph import repeated, with_both_ends

#: One table for both: an edge has source and target, a node none. properties is JSON.
SCHEMA = "kind string, id string, type string, source string, target string, properties string"
BATCH_ROWS = 10_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """Any file system that pyarrow knows by its scheme; a bare path is a local one."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _manifest(options: dict) -> dict | None:
    system, root = _open(options["path"])
    name = posixpath.join(root, options.get("dataset", "graph"), "manifest.json")
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(name) as f:
        return json.loads(f.read())


@dataclass
class Part(WriterCommitMessage):
    file: str
    nodes: int
    edges: int


@dataclass
class File(InputPartition):
    name: str


class GraphWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options, self.build = options, uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, root = _open(self.options["path"])
        home = posixpath.join(root, self.options.get("dataset", "graph"))
        return system, home, posixpath.join(home, f"build-{self.build}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One file for each task's attempt, batch by batch; an attempt that is repeated leaves a file that no commit names."""
        system, _, folder = self._folder()
        system.create_dir(folder, recursive=True)
        name, counts, out = posixpath.join(folder, f"{uuid.uuid4().hex}.parquet"), {"node": 0, "edge": 0}, None
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(at, BATCH_ROWS)
                    for kind in part.column("kind").to_pylist():
                        if kind not in counts:
                            raise ValueError(f"neither node nor edge: {kind!r}")
                        counts[kind] += 1
                    out = out or pq.ParquetWriter(name, part.schema, filesystem=system)
                    out.write_batch(part)
        finally:
            if out:
                out.close()
        return Part(name if out else "", counts["node"], counts["edge"])

    def commit(self, messages: list) -> None:
        system, home, folder = self._folder()
        parts = [m for m in messages if m is not None]
        found = {"nodes": sum(p.nodes for p in parts), "edges": sum(p.edges for p in parts)}
        for what, n in found.items():
            asked = self.options.get(f"expected_{what}")
            if asked is not None and int(asked) != n:
                self.abort(messages)
                raise ValueError(f"{n} {what} were written, {asked} expected")
        system.create_dir(folder, recursive=True)
        text = json.dumps({"build": self.build, "files": sorted(p.file for p in parts if p.file), **found})
        fresh = posixpath.join(folder, "manifest.json")
        with system.open_output_stream(fresh) as f:
            f.write(text.encode())
        system.move(fresh, posixpath.join(home, "manifest.json"))
        # the build before, and what late tasks of failed loads have left
        for info in system.get_file_info(fs.FileSelector(home)):
            if info.type == fs.FileType.Directory and info.base_name != f"build-{self.build}":
                system.delete_dir(info.path)

    def abort(self, messages: list) -> None:
        system, _, folder = self._folder()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class GraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[File]:
        manifest = _manifest(self.options)
        return [File(x) for x in manifest["files"]] if manifest and manifest["files"] else [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            system, _ = _open(self.options["path"])
            with system.open_input_file(partition.name) as f:
                yield from pq.ParquetFile(f).iter_batches(BATCH_ROWS)


class GraphStore(DataSource):
    """Options: path (a folder that all executors share), dataset, expected_nodes, expected_edges."""

    @classmethod
    def name(cls) -> str:
        return "graph_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GraphReader:
        return GraphReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GraphWriter:
        if not overwrite:
            raise ValueError("a load replaces the dataset: use mode overwrite")
        return GraphWriter(dict(self.options))


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, n: what keeps a graph from being loaded. Empty for a sound one.

    nodes: id, type; edges: id, source, target, type. Repeated or null ids, types that aren't upper-case names, and ends
    that aren't nodes.
    """
    named = lambda c: ~F.coalesce(F.col(c).rlike("^[A-Z_]+$"), F.lit(False))
    sound = with_both_ends(edges, nodes, "id").groupBy().agg(F.count("*").alias("n"))
    ends = edges.groupBy().agg(F.count("*").alias("m")).join(sound, F.lit(True)).select(F.lit("DANGLING_EDGE").alias("problem"), (F.col("m") - F.col("n")).alias("n"))
    out = ends
    for what, rows in (("NODE", nodes), ("EDGE", edges)):
        out = out.unionByName(repeated(rows, ["id"]).agg(F.count("*").alias("n")).select(F.lit(f"REPEATED_{what}").alias("problem"), "n"))
        flags = rows.agg(F.count_if(F.col("id").isNull()).alias("id"), F.count_if(named("type")).alias("type"))
        out = out.unionByName(flags.select(F.lit(f"{what}_WITHOUT_ID").alias("problem"), F.col("id").alias("n"))).unionByName(flags.select(F.lit(f"{what}_TYPE").alias("problem"), F.col("type").alias("n")))
    return out.filter("n > 0")


def load_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, path: str, dataset: str = "graph") -> None:
    """Replaces a dataset by nodes (id, type, properties) and edges (id, source, target, type, properties), or raises and
    leaves it as it was."""
    bad = graph_problems(nodes, edges).collect()
    if bad:
        raise ValueError(f"graph can't be loaded: {sorted((r['problem'], r['n']) for r in bad)}")
    spark.dataSource.register(GraphStore)
    none = F.lit(None).cast("string")
    rows = nodes.select(F.lit("node").alias("kind"), "id", "type", none.alias("source"), none.alias("target"), "properties")
    rows = rows.unionByName(edges.select(F.lit("edge").alias("kind"), "id", "type", "source", "target", "properties"))
    write = rows.write.format("graph_store").option("path", path).option("dataset", dataset)
    write.option("expected_nodes", str(nodes.count())).option("expected_edges", str(edges.count())).mode("overwrite").save()


def read_graph(spark: SparkSession, path: str, dataset: str = "graph") -> DataFrame:
    """kind, id, type, source, target, properties of the build in force; no row where none is."""
    spark.dataSource.register(GraphStore)
    return spark.read.format("graph_store").option("path", path).option("dataset", dataset).load()

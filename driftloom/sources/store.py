"""Document stores on a shared file system.

A store is a folder with a manifest and a Parquet table for each attachment, and tables of blobs
and blob chunks. The manifest names the tables and pins their files; it is written last, by an atomic
rename, so a store is complete or does not exist. Files are reached through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S

from driftloom.catalog.catalog import Catalog

MANIFEST = "manifest.json"
BLOBS = S.StructType([S.StructField("blob_id", S.StringType()), S.StructField("layout", S.StringType()), S.StructField("size", S.LongType())])
CHUNKS = S.StructType([S.StructField("blob_id", S.StringType()), S.StructField("chunk_no", S.IntegerType()), S.StructField("bytes", S.BinaryType())])
#: Rows of blob chunks stay small enough for row buffers.
CHUNK_BYTES = 8 << 20


class Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.root = path.rstrip("/")
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}".rstrip("/")))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(f"{self.root}/{name}".rstrip("/")), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        part = self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(part, self._path(f"{self.root}/{name}")):
            raise OSError(f"cannot publish {self.root}/{name}")

    def list(self, name: str) -> list[str]:
        p = self._path(f"{self.root}/{name}")
        return sorted(f.getPath().toString() for f in self._fs.listStatus(p) if f.isFile() and f.getPath().getName().endswith(".parquet"))


@dataclass
class Store:
    spark: SparkSession
    path: str
    catalog: Catalog
    kind: str = "documents"
    tables: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        """Reads the manifest; the files it pins are what the store reads from then on."""
        files = Files(spark, path)
        if not files.exists(MANIFEST):
            raise FileNotFoundError(f"no store at {path}")
        m = json.loads(files.read(MANIFEST))
        return Store(spark, path, Catalog.from_json(m["catalog"]), m["kind"], m["tables"])

    def read(self, name: str, schema: S.StructType) -> DataFrame:
        if files := self.tables.get(name):
            return self.spark.read.schema(schema).parquet(*files)
        return self.spark.createDataFrame([], schema)

    def attachment(self, attachment_id: str) -> DataFrame:
        return self.read(attachment_id, self.catalog.table_schema(self.catalog.attachment(attachment_id)))

    @property
    def blobs(self) -> DataFrame:
        return self.read("blobs", BLOBS)

    @property
    def chunks(self) -> DataFrame:
        return self.read("blob_chunks", CHUNKS)


class Writer:
    """Stages tables and publishes them together. Leaving the block with an error removes all."""

    def __init__(self, spark: SparkSession, path: str, catalog: Catalog, kind: str = "documents"):
        self.spark, self.path, self.catalog, self.kind = spark, path.rstrip("/"), catalog, kind
        self.files, self.tables = Files(spark, path), {}

    def __enter__(self) -> Writer:
        if self.files.exists():
            raise FileExistsError(f"{self.path} exists already")
        return self

    def write(self, name: str, rows: DataFrame) -> None:
        folder = name.replace("::", ".")
        rows.write.parquet(f"{self.path}/{folder}")
        self.tables[name] = self.files.list(folder)

    def __exit__(self, kind, *_):
        if kind is None:
            self.files.write(MANIFEST, json.dumps({"kind": self.kind, "catalog": self.catalog.to_json(), "tables": self.tables}, indent=1))
        else:
            self.files.delete()
        return False


def create(spark: SparkSession, path: str, catalog: Catalog, tables: dict[str, DataFrame], blobs: DataFrame | None = None, chunks: DataFrame | None = None) -> Store:
    """A store from frames by attachment id; columns are taken by name."""
    with Writer(spark, path, catalog) as w:
        for a in catalog.attachments:
            if a.id in tables:
                schema = catalog.table_schema(a)
                w.write(a.id, tables[a.id].select(*(tables[a.id][f.name].cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields)))
        if blobs is not None:
            w.write("blobs", blobs)
        if chunks is not None:
            w.write("blob_chunks", chunks)
    return Store.open(spark, path)

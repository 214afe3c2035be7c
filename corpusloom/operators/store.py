"""Collections of chunks in Parquet.

A collection's rows lie in buckets by a hash of their document. A change writes the rows of the buckets it
touches into a new folder and then publishes a numbered manifest, which says where each bucket's rows are. Published
manifests and their folders are never changed, so a reader sees one whole version. Of two
writers of one version, the second fails and may try again. A chunk id belongs to one document.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.config import CollectionNotFoundError, ConfigurationError, DocumentNotFoundError, collection_name
from corpusloom.operators.filters import predicate


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key isn't among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def without_document(old: DataFrame, document: str) -> DataFrame:
    return old.where(~F.col("document_id").eqNullSafe(document))


def without_matching(old: DataFrame, where: dict) -> DataFrame:
    """Rows that a filter doesn't match; an unknown match stays."""
    return old.where(~F.coalesce(predicate(old, where), F.lit(False)))


def pick(chunks: DataFrame, keys: list | DataFrame, key: str = "id") -> DataFrame:
    """The chunks of some keys, given as a short list or as a table with a column ``key``."""
    if isinstance(keys, DataFrame):
        return chunks.join(keys.select(key).distinct(), key, "left_semi")
    return chunks.where(F.col(key).isin(keys))


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, collection_name(name)
        self.root = f"{root.rstrip('/')}/{self.name}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def exists(self) -> bool:
        return bool(self.versions())

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise CollectionNotFoundError(self.name)
        lines = self.spark.read.text(f"{self.root}/manifests/{version or known[-1]:012d}.json", wholetext=True)
        return json.loads(lines.first()[0])

    def _publish(self, manifest: dict) -> None:
        """Writes the next manifest beside its place and moves it there, if no other writer was faster."""
        fs, path = self._fs()
        target = path(f"{self.root}/manifests/{manifest['version']:012d}.json")
        fresh = path(f"{self.root}/fresh/{uuid.uuid4().hex}.json")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(fresh, target):
            fs.delete(fresh, False)
            raise ConfigurationError(f"version {manifest['version']} of {self.name} was written by someone else")

    def _bucket(self, df: DataFrame, buckets: int) -> Column:
        of = "document_id" if "document_id" in df.columns else "id"
        return F.pmod(F.xxhash64(F.coalesce(F.col(of).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, buckets: int) -> tuple[str, list[str]]:
        """Writes rows to a new folder; its name and the buckets in it."""
        folder = uuid.uuid4().hex
        placed = df.withColumn("_bucket", self._bucket(df, buckets))
        placed.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/data/{folder}")  # a hot bucket is split, small ones are put together
        return folder, [n.split("=")[1] for n in self._names(f"data/{folder}") if n.startswith("_bucket=")]

    def _rows(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/data/{f}/_bucket={b}" for b, folders in manifest["buckets"].items() if only is None or b in only for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _merged(old: StructType, new: StructType) -> dict:
        return StructType([*old.fields, *[f for f in new.fields if f.name not in old.fieldNames()]]).jsonValue()

    def create(self, chunks: DataFrame, buckets: int = 16) -> None:
        if self.exists():
            raise ConfigurationError(f"collection {self.name} exists")
        folder, written = self._write(chunks, buckets)
        self._publish({"version": 1, "count": buckets, "schema": chunks.schema.jsonValue(), "buckets": {b: [folder] for b in written}})

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(version))

    def _rewrite(self, manifest: dict, touched: set[str], rows: DataFrame) -> None:
        """Publishes ``rows`` as all there is in the touched buckets; the others stay where they are."""
        folder, written = self._write(rows, manifest["count"])
        left = {b: f for b, f in manifest["buckets"].items() if b not in touched}
        schema = self._merged(StructType.fromJson(manifest["schema"]), rows.schema)
        self._publish({**manifest, "version": manifest["version"] + 1, "schema": schema, "buckets": left | {b: [folder] for b in written}})

    def _touched(self, rows: DataFrame, manifest: dict) -> set[str]:
        return {str(r[0]) for r in rows.select(self._bucket(rows, manifest["count"])).distinct().collect()}  # at most as many as buckets

    def replace(self, chunks: DataFrame) -> None:
        manifest = self._manifest()
        self._rewrite(manifest, set(manifest["buckets"]), chunks)

    def add(self, chunks: DataFrame) -> None:
        """Appends new chunks; none at all, repeated ids or ids stored already are refused."""
        if not self.exists():
            self._check_new(chunks)
            self.create(chunks)
            return
        manifest = self._manifest()
        folder, written = self._write(chunks, manifest["count"])
        fresh = self._rows({**manifest, "schema": chunks.schema.jsonValue(), "buckets": {b: [folder] for b in written}})
        try:
            self._check_new(fresh)
            if fresh.join(self._rows(manifest, set(written)).select("id"), "id", "left_semi").limit(1).count():
                raise ConfigurationError("some ids are stored already")
        except ConfigurationError:
            fs, path = self._fs()
            fs.delete(path(f"{self.root}/data/{folder}"), True)
            raise
        buckets = dict(manifest["buckets"])
        for b in written:
            buckets[b] = [*buckets.get(b, []), folder]
        self._publish({**manifest, "version": manifest["version"] + 1, "schema": self._merged(StructType.fromJson(manifest["schema"]), chunks.schema), "buckets": buckets})

    @staticmethod
    def _check_new(chunks: DataFrame) -> None:
        most = chunks.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most is None:
            raise ConfigurationError("there are no chunks to add")
        if most > 1:
            raise ConfigurationError("some ids are repeated")

    def upsert(self, chunks: DataFrame) -> None:
        manifest = self._manifest()
        touched = self._touched(chunks, manifest)
        self._rewrite(manifest, touched, upsert(self._rows(manifest, touched), chunks))

    def delete(self, keys: DataFrame) -> None:
        manifest = self._manifest()
        touched = self._touched(self._rows(manifest).join(keys.select("id").distinct(), "id", "left_semi"), manifest)
        if touched:
            self._rewrite(manifest, touched, without(self._rows(manifest, touched), keys))

    def delete_document(self, document: str) -> int:
        """The number of chunks deleted, 0 if there is no such document."""
        manifest = self._manifest()
        mine = self._rows(manifest).where(F.col("document_id") == document)
        touched = self._touched(mine, manifest)
        n = mine.count() if touched else 0
        if touched:
            self._rewrite(manifest, touched, without_document(self._rows(manifest, touched), document))
        return n

    def delete_where(self, where: dict) -> None:
        manifest = self._manifest()
        rows = self._rows(manifest)
        touched = self._touched(rows.where(predicate(rows, where)), manifest)
        if touched:
            self._rewrite(manifest, touched, without_matching(self._rows(manifest, touched), where))

    def get(self, key: str):
        row = self.read().where(F.col("id") == key).first()
        if row is None:
            raise DocumentNotFoundError(key)
        return row

    def count(self) -> int:
        return self.read().count()

    def clear(self) -> None:
        manifest = self._manifest()
        self._publish({**manifest, "version": manifest["version"] + 1, "buckets": {}})

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last versions, and the folders that only they use."""
        fs, path = self._fs()
        known = self.versions()
        used = {f for v in known[-keep:] for folders in self._manifest(v)["buckets"].values() for f in folders}
        for v in known[:-keep]:
            fs.delete(path(f"{self.root}/manifests/{v:012d}.json"), False)
        for folder in self._names("data"):
            if folder not in used:
                fs.delete(path(f"{self.root}/data/{folder}"), True)

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)


def list_collections(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if Collection(spark, root, s.getPath().getName()).exists())


def as_layout(chunks: DataFrame, target: str) -> DataFrame:
    """The chunks in the layout of a vector store; who wins on a clash of ``content`` depends on it."""
    own = F.create_map(F.lit("content"), F.col("content"))
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))

    def merged(first, second):  # entries of the second win
        keep = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
        return F.map_concat(keep, second)

    if target == "chroma":
        return chunks.select("id", F.col("content").alias("document"), "embedding", meta.alias("metadata"))
    if target == "pinecone":
        return chunks.select("id", F.col("embedding").alias("values"), merged(meta, own).alias("metadata"))
    if target == "weaviate":
        return chunks.select("id", merged(own, meta).alias("properties"), F.col("embedding").alias("vector"))
    if target == "qdrant":
        return chunks.select("id", F.col("embedding").alias("vector"), merged(own, meta).alias("payload"))
    if target == "milvus":
        return chunks.select("id", "content", "embedding", F.transform_keys(meta, lambda k, _: F.concat(F.lit("metadata_"), k)).alias("fields"))
    raise ConfigurationError(f"no layout {target}")

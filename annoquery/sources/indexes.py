"""Dataset indexes addressed by a manifest, as a Spark data source: ``spark.read.format("dataset_index")`` and ``df.write.format("dataset_index")``.

A folder holds several named indexes, each of compressed JSON-lines parts, and manifests. One write adds or replaces all indexes that its rows name (column ``index_name``), with their
counts: tasks write parts that nothing names yet, and the commit puts one new manifest, by a rename, in which the other
indexes stay as they were. Until then, and when a task is lost or the commit fails, readers see the manifest before. Parts of failed attempts are named by no manifest.

Options: ``path`` (any file system that Arrow opens), for reading ``index`` and optionally ``category`` (only records with an item of that category), for
writing ``indexes`` (comma-separated names that get an entry even without rows; others are refused).
"""

from __future__ import annotations

import gzip
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "index_name string, record string"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def manifest(path: str) -> dict:
    """The newest manifest: ``version`` and ``indexes`` (name -> count and parts with their counts); empty before the first write."""
    from pyarrow import fs

    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))
    if not names:
        return {"version": 0, "indexes": {}}
    with store.open_input_stream(f"{root}/{names[-1]}") as file:
        return json.loads(file.readall())


@dataclass
class Parts(WriterCommitMessage):
    """What a task wrote: index name -> (part, rows)."""

    parts: dict


@dataclass
class Part(InputPartition):
    name: str


class DatasetIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dataset_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return IndexWriter(self.options)


class IndexReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.index, self.category = options["path"], options["index"], options.get("category")

    def partitions(self) -> list[Part]:
        known = manifest(self.path)["indexes"]
        if self.index not in known:
            raise ValueError(f"no index {self.index!r}; there are {', '.join(sorted(known)) or 'none'}")
        return [Part(p["part"]) for p in known[self.index]["parts"]]

    def read(self, partition):
        if not isinstance(partition, Part):  # an index without rows
            return
        store, root = _opened(self.path)
        with store.open_input_stream(f"{root}/{partition.name}", compression=None) as raw, gzip.open(raw, "rt", encoding="utf-8") as lines:
            for line in lines:
                line = line.rstrip("\n")
                if self.category is None or any(isinstance(i, dict) and i.get("category_name") == self.category for i in json.loads(line).get("items") or []):
                    yield self.index, line


class IndexWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.names = options["path"], [n for n in options.get("indexes", "").split(",") if n]
        self.job = uuid.uuid4().hex

    def write(self, rows) -> Parts:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        open_, made = {}, {}
        try:
            for name, record in rows:
                if name not in self.names:
                    raise ValueError(f"{name!r} is not among the indexes to write")
                if name not in open_:
                    part = f"{name}-{self.job}-{uuid.uuid4().hex}.jsonl.gz"
                    raw = store.open_output_stream(f"{root}/{part}", compression=None)
                    open_[name], made[name] = (raw, gzip.open(raw, "wb")), [part, 0]
                open_[name][1].write(record.encode() + b"\n")
                made[name][1] += 1
        finally:
            for raw, packed in open_.values():
                packed.close()
                raw.close()
        return Parts(made)

    def commit(self, messages) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        before, new = manifest(self.path), {name: {"count": 0, "parts": []} for name in self.names}
        for message in messages:
            for name, (part, n) in message.parts.items():
                new[name]["parts"].append({"part": part, "count": n})
                new[name]["count"] += n
        version = before["version"] + 1
        whole = {"version": version, "written": int(time.time()), "indexes": before["indexes"] | new}
        hidden = f"{root}/.{self.job}"
        with store.open_output_stream(hidden) as file:
            file.write(json.dumps(whole, ensure_ascii=False).encode())
        store.move(hidden, f"{root}/manifest-{version:012d}.json")

    def abort(self, messages) -> None:
        store, root = _opened(self.path)
        for message in messages:
            for part, _ in (message.parts if message else {}).values():
                store.delete_file(f"{root}/{part}")


def build_indexes(spark: SparkSession, path: str, indexes: dict[str, DataFrame]) -> dict[str, int]:
    """Write all indexes in one commit; returns their counts. A missing one (None) gets an entry without rows."""
    spark.dataSource.register(DatasetIndex)
    rows = spark.createDataFrame([], SCHEMA)
    for name, df in indexes.items():
        if df is not None:
            rows = rows.unionAll(df.select(F.lit(name).alias("index_name"), F.to_json(F.struct(*df.columns)).alias("record")))
    rows.write.format("dataset_index").option("indexes", ",".join(indexes)).mode("append").save(path)
    return {name: entry["count"] for name, entry in manifest(path)["indexes"].items()}


def read_index(spark: SparkSession, path: str, index: str, schema: str, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Records of an index, those with an item of a category, at most ``limit``; an unknown name is an error."""
    if limit is not None and limit < 0:
        raise ValueError("a limit can't be negative")
    spark.dataSource.register(DatasetIndex)
    source = spark.read.format("dataset_index").option("index", index)
    rows = (source if category is None else source.option("category", category)).load(path)
    out = rows.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return out if limit is None else out.limit(limit)


def index_record(samples: DataFrame, with_annotation: bool = True) -> DataFrame:
    """Compact records of samples: raw attributes are left out, items keep category, id, style and box, the annotation's path only where there is one."""
    item = lambda i: F.struct(i["category_name"].alias("category_name"), i["category_id"].alias("category_id"), i["style"].alias("style"), i["bounding_box"].alias("bounding_box"))
    kept = [c for c in samples.columns if c not in ("items", "raw_attributes", "annotation_path")]
    more = ["annotation_path"] if with_annotation and "annotation_path" in samples.columns else []
    return samples.select(*kept, *more, F.transform("items", item).alias("items"))

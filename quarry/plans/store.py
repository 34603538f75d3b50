"""A versioned store of chunk, text and state tables.

Every table is split by a hash of rel_path into buckets of about BUCKET_BYTES of sources, so their number follows the tree
and what one task writes does not; a store that outgrows its buckets is dealt anew.  A change writes its own rows and the paths of the files
that they replace as a version of the buckets that it touches, and then replaces the manifest, which names the versions of every bucket;
readers follow the manifest and leave out rows of replaced files, so a change is visible as a whole or not at all, and it costs what changed.
A bucket of more than MOST_VERSIONS is rewritten as one.  Postings are made from the chunks as they lie, and sorted by term within a
file, so a term lookup skips row groups.  Texts of indexed chunks are those of the chunks table and not kept twice.
"""

from __future__ import annotations

import gc
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.keyword import build_index
from quarry.operators.vector import check_dim

VECTORS = "id string, content_hash string, vector array<float>, rel_path string, start_line int, end_line int, symbol_name string, symbol_type string, language string, content string, last_modified long"
TABLES = {
    "chunks": VECTORS,
    "texts": "id string, rel_path string, content string, symbol_name string, language string, start_line int, end_line int, index_depth string",
    "postings": "field string, term string, id string, tf int, positions array<int>, rel_path string",
    "lengths": "field string, id string, n int, rel_path string",
    "state": "rel_path string, hash string, status string, indexed_at long",
}
SORTED = {"postings": ["term", "id"], "chunks": ["rel_path", "start_line"]}
#: Sources that one bucket is to hold; fewer buckets than LEAST_BUCKETS are never made.
BUCKET_BYTES, LEAST_BUCKETS = 256 << 20, 16
#: A bucket of so many versions is left as it is.
MOST_VERSIONS = 4
#: Ids stay in a file's dictionary, though they are long and many.
FORMAT = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20), "parquet.page.size": str(8 << 20), "parquet.page.row.count.limit": "100000"}


def buckets_for(source_bytes: int) -> int:
    return max(LEAST_BUCKETS, -(-source_bytes // BUCKET_BYTES))


def shared_root(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, on one machine else below /tmp/checkpoints."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    return f"{(top or '/tmp/checkpoints').rstrip('/')}/store-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that are done with: it does so once the driver's objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


class Store:
    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest

    # -- opening -------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, *, model: str, dim: int, buckets: int = LEAST_BUCKETS) -> Store:
        store = cls(spark, root, {"model": model, "dim": dim, "n_buckets": buckets, "version": 0, "tables": {t: {} for t in TABLES}, "last_full_index_at": None, "inserted": 0, "deleted": 0, "phase": "building"})
        store._publish()
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str, *, model: str | None = None, dim: int | None = None) -> Store:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest.json")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(f"no index at {root}; index it first")
        text = "\n".join(r.value for r in spark.read.text(f"{root}/manifest.json").collect())
        manifest = json.loads(text)
        for key, value in (("model", model), ("dim", dim)):
            if value is not None and manifest[key] != value:
                raise ValueError(f"the index was made with {key} {manifest[key]!r}, not {value!r}; index again with force_full")
        return cls(spark, root, manifest)

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, *, model: str, dim: int, buckets: int = LEAST_BUCKETS) -> Store:
        """The store at ``root``, with at least half as many buckets as are asked for."""
        try:
            store = cls.open(spark, root, model=model, dim=dim)
        except FileNotFoundError:
            return cls.create(spark, root, model=model, dim=dim, buckets=buckets)
        if buckets > 2 * store.manifest["n_buckets"]:
            store.rebucket(buckets)
        return store

    def _publish(self) -> None:
        """Write the manifest beside the old one and rename it over: readers see one or the other."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        part, final = (jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}") for n in (f"manifest-{uuid.uuid4().hex}.tmp", "manifest.json"))
        fs = final.getFileSystem(conf)
        fs.mkdirs(final.getParent())
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), conf).rename(part, final, self._overwrite())

    def _overwrite(self):
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(kind, 1)
        array[0] = kind.OVERWRITE
        return array

    # -- reading -------------------------------------------------------------

    def bucket(self, c="rel_path"):
        return F.pmod(F.xxhash64(c), F.lit(self.manifest["n_buckets"])).cast("int")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self._kept(name, buckets)
        if name != "texts":
            return rows
        deep = self._kept("chunks", buckets).withColumns({"symbol_name": F.coalesce("symbol_name", F.lit("")), "index_depth": F.lit("deep")})
        return deep.select(*rows.columns).unionByName(rows)

    def _kept(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's own rows, of files that no later version replaced."""
        wanted = lambda of: {int(b): v if isinstance(v, list) else [v] for b, v in of.items() if buckets is None or int(b) in buckets}
        there, gone = wanted(self.manifest["tables"][name]), wanted(self.manifest.get("gone", {}).get(name, {}))
        by_version: dict[int, list[str]] = {}
        for b, versions in there.items():
            for v in versions:
                by_version.setdefault(v, []).append(f"{self.root}/{name}/v{v}/bucket={b}")
        parts = [self.spark.read.schema(TABLES[name]).parquet(*paths).withColumn("v", F.lit(v)) for v, paths in sorted(by_version.items())]
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        lists = {v: [f"{self.root}/gone/v{v}/bucket={b}" for b in gone if v in gone[b] and b in there and v > min(there[b])] for v in {v for x in gone.values() for v in x}}
        replaced = [self.spark.read.schema("rel_path string").parquet(*paths).withColumn("later", F.lit(v)) for v, paths in sorted(lists.items()) if paths]
        if not replaced:
            return rows.drop("v")
        last = replaced[0]
        for p in replaced[1:]:
            last = last.unionByName(p)
        last = last.groupBy(F.col("rel_path").alias("path")).agg(F.max("later").alias("later"))
        return rows.join(last, (F.col("rel_path") == F.col("path")) & (F.col("later") > F.col("v")), "left_anti").drop("v")

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def index(self, deep_only: bool = False) -> dict[str, DataFrame]:
        docs = self.table("texts")
        return {"postings": self.table("postings"), "lengths": self.table("lengths"), "docs": docs.filter("index_depth = 'deep'") if deep_only else docs}

    def chunks_by_ids(self, ids: DataFrame) -> DataFrame:
        """Chunk rows of the given ids, without vectors."""
        return self.chunks.drop("vector").join(ids.select("id"), "id", "left_semi")

    def existing_embeddings(self, files: DataFrame) -> DataFrame:
        """(content_hash, vector) of the given files' chunks, read from their buckets only."""
        return self.table("chunks", self.buckets_of(files)).join(files.select("rel_path"), "rel_path", "left_semi").select("content_hash", "vector")

    def buckets_of(self, files: DataFrame) -> list[int]:
        """Numbers of the buckets that hold these paths: at most n_buckets of them reach the driver."""
        return sorted(r[0] for r in files.select(self.bucket().alias("b")).distinct().collect())

    # -- changing ------------------------------------------------------------

    def replace(self, files: DataFrame, rows: dict[str, DataFrame], index: bool = False, **facts) -> None:
        """In each given table, put ``rows`` in place of whatever it held for ``files``; publish all at once.  With ``index``, postings
        and lengths of the new chunks too."""
        touched = self.buckets_of(files)
        if "chunks" in rows:
            rows = rows | {"chunks": check_dim(rows["chunks"], self.manifest["dim"])}
        version = self.manifest["version"] + 1
        tables = {t: dict(v) for t, v in self.manifest["tables"].items()}
        gone = {t: dict(v) for t, v in self.manifest.get("gone", {}).items()}
        listed = False
        for name in [*rows, *(("postings", "lengths") if index else ())]:
            cols = [f.split()[0] for f in TABLES[name].split(", ")]
            if name == "state":  # small rows: always one version
                kept = self.table(name, touched).join(files.select("rel_path"), "rel_path", "left_anti").select(*cols)
                new = self._dealt(kept.unionByName(rows[name].select(*cols)), len(touched))
            elif name in rows:
                new = self._dealt(rows[name].select(*cols), len(touched))
            else:
                new = self._made(version)[name].select(*cols, "bucket")
            there = self._write(new, name, version)
            for b in map(str, touched):
                if name == "state":
                    tables[name].pop(b, None)
                elif b in tables[name]:
                    if not listed:
                        self._dealt(files.select("rel_path").distinct(), len(touched)).write.options(**FORMAT).partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/gone/v{version}")
                        listed = True
                    gone.setdefault(name, {})[b] = [*gone.get(name, {}).get(b, []), version]
                if int(b) in there:
                    before = tables[name].get(b, [])
                    tables[name][b] = [*(before if isinstance(before, list) else [before]), version]
        self.manifest |= facts | {"version": version, "tables": tables, "gone": gone}
        self._publish()
        self._compact(touched)

    def _made(self, version: int) -> dict[str, DataFrame]:
        """Postings and lengths of one version's chunks, made where these lie, with their bucket."""
        docs = self.spark.read.schema(f"{VECTORS}, bucket int").parquet(f"{self.root}/chunks/v{version}")
        return build_index(docs.select("id", "rel_path", "bucket", "content", F.coalesce("symbol_name", F.lit("")).alias("symbol_name")), keep=("rel_path", "bucket"))

    def _compact(self, touched: list[int]) -> None:
        """Rewrite buckets of many versions or lists of replaced files as one version each."""
        many = lambda of: {int(b) for b, v in of.items() if isinstance(v, list) and len(v) > MOST_VERSIONS and int(b) in touched}
        gone = self.manifest.get("gone", {})
        todo = {t: sorted(many(v) | many(gone.get(t, {}))) for t, v in self.manifest["tables"].items()}
        if not any(todo.values()):
            return
        version = self.manifest["version"] + 1
        tables, gone = {t: dict(v) for t, v in self.manifest["tables"].items()}, {t: dict(v) for t, v in gone.items()}
        for name, buckets in todo.items():
            if buckets:
                there = self._write(self._dealt(self._kept(name, buckets), len(buckets)), name, version)
                for b in buckets:
                    tables[name].pop(str(b), None)
                    gone.get(name, {}).pop(str(b), None)
                tables[name] |= {str(b): [version] for b in there}
        self.manifest |= {"version": version, "tables": tables, "gone": gone}
        self._publish()

    def rebucket(self, n: int) -> None:
        """Deal all rows into ``n`` buckets and publish them at once; readers of the old manifest keep the old files."""
        old, version = Store(self.spark, self.root, dict(self.manifest)), self.manifest["version"] + 1
        self.manifest |= {"n_buckets": n, "version": version}
        self.manifest |= {"tables": {t: {str(b): [version] for b in self._write(self._dealt(old._kept(t), n), t, version)} for t in TABLES}, "gone": {}}
        self._publish()

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("bucket", self.bucket()).repartition(max(1, n), "bucket")

    def _write(self, rows: DataFrame, name: str, version: int) -> set[int]:
        """Write rows with their bucket as one version of a table; the buckets that have any."""
        path = f"{self.root}/{name}/v{version}"
        rows.sortWithinPartitions("bucket", *SORTED.get(name, ["rel_path"])).write.options(**FORMAT).partitionBy("bucket").mode("overwrite").parquet(path)
        release(self.spark)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        return {int(x.removeprefix("bucket=")) for x in names if x.startswith("bucket=")}

    def drop(self, path: str) -> None:
        """Delete a folder below the store's root."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def text_rows(self, docs: DataFrame) -> dict[str, DataFrame]:
        """texts, postings and lengths of docs (texts' columns) that have no chunks."""
        made = build_index(docs, keep=("rel_path",))
        return {"texts": docs, "postings": made["postings"], "lengths": made["lengths"]}

    def insert_chunks(self, rows: DataFrame) -> int:
        """Append chunk rows; an empty batch changes nothing."""
        n = rows.count()
        if n:
            files = rows.select("rel_path").distinct()
            old = self.table("chunks", self.buckets_of(files)).join(files, "rel_path", "left_semi")
            self.replace(files, {"chunks": old.unionByName(rows.select(*old.columns))}, inserted=self.manifest["inserted"] + n)
        return n

    def delete_by_files(self, files: DataFrame, tables: tuple[str, ...] = ("chunks", "texts", "postings", "lengths")) -> int:
        """Rows of the vector table that went; paths are matched exactly."""
        n = self.table("chunks", self.buckets_of(files)).join(files.select("rel_path"), "rel_path", "left_semi").count()
        self.replace(files, {t: self.spark.createDataFrame([], TABLES[t]) for t in tables}, deleted=self.manifest["deleted"] + n)
        return n

    def optimize(self) -> None:
        """Drop the versions that the manifest no longer names."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        lists: dict[str, list[int]] = {}
        for of in self.manifest.get("gone", {}).values():
            for b, versions in of.items():
                lists[b] = lists.get(b, []) + versions
        for name, used in (self.manifest["tables"] | {"gone": lists}).items():
            top = p(f"{self.root}/{name}")
            fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for v in fs.listStatus(top) if fs.exists(top) else []:
                for b in fs.listStatus(v.getPath()):
                    key = b.getPath().getName().removeprefix("bucket=")
                    versions = used.get(key, [])
                    if key.isdigit() and int(v.getPath().getName()[1:]) not in (versions if isinstance(versions, list) else [versions]):
                        fs.delete(b.getPath(), True)

    # -- state ---------------------------------------------------------------

    def set_status(self, files: DataFrame, status: str, now: int | None = None) -> None:
        """files has rel_path and hash; later rows win."""
        when = F.lit(int(time.time()) if now is None else now) if status == "indexed" else F.lit(None)
        self.replace(files.select("rel_path"), {"state": files.select("rel_path", "hash", F.lit(status).alias("status"), when.cast("long").alias("indexed_at"))})

    def pending(self) -> DataFrame:
        return self.table("state").filter("status = 'pending'")

    def set_phase(self, phase: str, now: int | None = None) -> None:
        """building < partial < full; partial never replaces full."""
        order = ["building", "partial", "full"]
        if not (phase == "partial" and self.manifest["phase"] == "full"):
            self.manifest["phase"] = order[order.index(phase)]
        if phase == "full":
            self.manifest["last_full_index_at"] = int(time.time()) if now is None else now
        self._publish()

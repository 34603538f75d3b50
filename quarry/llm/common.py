"""What the training-data operators share: the shared folder, staged tables, row locators and components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D (Java regex syntax).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def conf(spark: SparkSession, **values: str):
    """Settings of the session for as long as the block runs; ``__`` in a name stands for a dot."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows, for stages whose rows are wide."""
    return conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


#: Rows of an Arrow batch of texts, where a caller makes the rows.
BATCH_ROWS = 512


def few_rows(docs: DataFrame) -> DataFrame:
    """``docs``; from now on its session has Arrow batches of at most BATCH_ROWS rows.

    Frames that are made of it take the setting of the time when they are run.  Spark's 10 000 texts in a batch take large buffers
    on both sides of each worker, and an allocator does not give all of them back.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a qualified URI.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset (tests on one machine)
    is a folder under /tmp/checkpoints chosen and set; a cluster without it is an error.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(f"/tmp/checkpoints/quarry-{uuid.uuid4().hex}")
        top = sc.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


#: Paths made in the open scratch blocks, innermost last.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Paths made and tables staged in the block are deleted at its end, but for the staged tables passed to what it yields."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df.staged_at)
        if len(_scratch) > 1:
            _scratch[-2].append(df.staged_at)
        return df

    _scratch.append(paths)
    try:
        yield keep
    finally:
        _scratch.pop()
        for path in paths:
            drop_path(spark, path)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow; :func:`write_table` writes such rows in the worker that makes them."""
    out = df.mapInArrow(run, schema)
    out.mapped_from = (df, run)
    return out


def grouped(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """applyInArrow for a few large groups; :func:`write_table` writes a file for each of them, in the worker that makes it."""
    out = df.groupBy(*keys).applyInArrow(run, schema)
    out.grouped_from = (df, keys, run)
    return out


#: Types that Arrow and Parquet hand on to Spark's reader as they are.
_PLAIN = {"boolean", "byte", "short", "integer", "long", "float", "double", "string", "binary"}
#: Bytes of a row group of work tables.
GROUP_BYTES = 8 << 20


def _plain(kind) -> bool:
    name = kind.typeName()
    return name in _PLAIN or (name == "array" and _plain(kind.elementType)) or (name == "struct" and all(_plain(f.dataType) for f in kind.fields))


def write_table(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Write ``df`` as Parquet files to the new folder ``path``, from Python workers.

    Without its native library Hadoop starts a ``chmod`` for each file and folder that it makes under ``file:``.  Until such a
    child runs its program it shares all memory of the executor that starts it, which then counts twice; pyarrow starts none.
    Files of tasks that ended well are moved to their place by the driver; what other attempts leave goes.
    """
    from pyarrow import fs

    if not path.startswith("file:") or not all(_plain(f.dataType) for f in df.schema.fields):
        df.write.option("compression", compression).parquet(path)
        return
    names = df.columns
    source, run = getattr(df, "mapped_from", None) or (df.toDF(*[f"c{i}" for i in range(len(names))]), None)
    whole, keys, solve = getattr(df, "grouped_from", (None, None, None))

    def write(batches):
        import pyarrow as pa
        from pyarrow import parquet
        from pyspark import TaskContext

        from quarry.llm.hashing import trim

        store, top = fs.FileSystem.from_uri(path)
        file = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        out, held, size = None, [], 0

        def flush():
            nonlocal out, held, size
            t = pa.concat_tables([b if isinstance(b, pa.Table) else pa.Table.from_batches([b]) for b in held]).rename_columns(names)
            if out is None:
                texts = [f.name for f in t.schema if pa.types.is_string(f.type)]
                out = parquet.ParquetWriter(f"{top}/_temporary/{file}", t.schema, filesystem=store, compression=compression, use_dictionary=texts, write_statistics=False)
            out.write_table(t, row_group_size=t.num_rows)
            held, size = [], 0

        try:
            for b in run(batches) if run else batches:
                if b.num_rows:
                    held.append(b)
                    size += b.nbytes
                    if size >= GROUP_BYTES:
                        flush()
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
            trim()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"file": [file]})

    store, top = fs.FileSystem.from_uri(path)
    store.create_dir(f"{top}/_temporary")
    def write_group(key, t):
        import pyarrow as pa

        done = [b["file"][0].as_py() for b in write([solve(key, t).combine_chunks()])]
        return pa.table({"file": pa.array(done, pa.string())})

    rows = int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    with small_batches(df.sparkSession, min(rows, 2000) if rows > 0 else 2000):
        out = whole.groupBy(*keys).applyInArrow(write_group, "file string") if solve else source.mapInArrow(write, "file string")
        files = [r[0] for r in out.collect()]
    for file in files:
        store.move(f"{top}/_temporary/{file}", f"{top}/{file}")
    store.delete_dir(f"{top}/_temporary")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return _read_back(df, path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """As :func:`staged`, but by :func:`write_table`."""
    path = new_path(df.sparkSession, name)
    write_table(df, path, **options)
    return _read_back(df, path)


def _read_back(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t.staged_at)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def make_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that are done with: it does so once the driver's objects are collected."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def map_rows(df: DataFrame, run) -> DataFrame:
    """mapInArrow over all columns, whatever their names: the batches' columns are c0, c1, ... and so are the results'."""
    from quarry.llm.hashing import trim

    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    out = plain.mapInArrow(trimmed, plain.schema).toDF(*names)
    out.mapped_from = (plain, trimmed)
    return out


def located(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns that name each row's place: file and row number in it.

    Rows that did not come straight from files are written to the shared folder first.
    The names never clash with a column of ``docs``.
    """
    names = {c.lower() for c in docs.columns}
    at, row = (free_name(names, x) for x in ("at_file", "at_row"))
    try:
        meta = docs.metadataColumn("_metadata")
        out = docs.withColumns({at: meta["file_path"], row: meta["row_index"]})
        out.schema  # noqa: B018  analysis fails here where rows have no file
    except Exception as e:
        if type(e).__name__ != "AnalysisException":
            raise
        docs = staged(docs, "rows")
        meta = docs.metadataColumn("_metadata")
        out = docs.withColumns({at: meta["file_path"], row: meta["row_index"]})
    return out, [at, row]


def choose_places(rows: DataFrame, at: list[str], chosen: DataFrame, keep: bool) -> DataFrame:
    """The rows whose place (columns ``at``) is among ``chosen`` (at, row), or with ``keep=False`` those whose place isn't.

    Neither side is shuffled or broadcast with its texts: the chosen row numbers of each input file are written to one
    small file in the shared folder, and each task reads those of the files that it scans.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash
    from pyarrow import fs

    spark = rows.sparkSession
    root = new_path(spark, "places")
    make_dir(spark, root)
    name = lambda file: xxhash.xxh3_128_hexdigest(file.encode())

    def write(key, t):
        store, top = fs.FileSystem.from_uri(root)
        file = key[0].as_py()
        part = f"{top}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(part, compression=None) as f:
            f.write(np.sort(t["row"].to_numpy()).astype(np.int64).tobytes())
        store.move(part, f"{top}/{name(file)}")
        return pa.table({"file": [file], "n": [t.num_rows]})

    total = chosen.select("at", "row").groupBy("at").applyInArrow(write, "file string, n long").agg({"n": "sum"}).first()[0]
    if not total:
        return rows.limit(0) if keep else rows
    i, j = rows.columns.index(at[0]), rows.columns.index(at[1])

    def run(batches):
        store, top = fs.FileSystem.from_uri(root)
        kept: dict[str, np.ndarray] = {}

        def numbers(file):
            if file not in kept:
                if len(kept) >= 4:
                    kept.clear()
                path = f"{top}/{name(file)}"
                there = store.get_file_info(path).type != fs.FileType.NotFound
                kept[file] = np.frombuffer(store.open_input_file(path).read(), np.int64) if there else np.empty(0, np.int64)
            return kept[file]

        for b in batches:
            files, row = b.column(i), b.column(j).to_numpy()
            mask = np.zeros(b.num_rows, dtype=bool)
            for file in pc.unique(files).to_pylist():
                own = pc.equal(files, file).to_numpy(zero_copy_only=False)
                mask[own] = np.isin(row[own], numbers(file), assume_unique=False)
            yield b.filter(pa.array(mask if keep else ~mask))

    return map_rows(rows, run)


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, whatever characters are in the names."""
    return df.select(*[F.col("`" + n.replace("`", "``") + "`") for n in names])


def free_name(taken: set[str], name: str) -> str:
    while name.lower() in taken:
        name += "_"
    return name


def empty_as(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b long): one row (v, root) per vertex, root the smallest vertex.

    Alternating large-star and small-star rounds; each round is staged, so the plan stays short, and its
    reductions combine map-side, so a vertex with very many links costs no single task.
    Self-links and repeated links are harmless.
    """
    spark = edges.sparkSession
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).filter("u > w").distinct(), name)
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("w > u").join(low, F.col("u") == F.col("k")).select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u > w").distinct()
        low = large.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u > w").unionByName(small.select("u", F.col("m").alias("w"))).distinct()
        e = written(small, name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("w").alias("root")).withColumnRenamed("u", "v").unionByName(e.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())

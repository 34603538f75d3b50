"""File trees as DataFrames.

Spark's ``binaryFile`` source lists and reads; size, extension, secret names and generated directories are filters on the
listing's columns, applied before contents are read.  Ignore files are read once on the driver (they are few and short)
and become one filter on the path.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.secrets import skip_file
from quarry.functions.text import extension, normal_path

# Generated or cache directories, pruned below the root.
PRUNED = [
    ".git", ".hg", ".svn", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox", ".turbo",
    ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "out", "target", "venv",
]
MAX_FILE_KB = 512


def ignore_regex(pattern: str, base: str = "") -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it re-includes) of one line of an ignore file in ``base``."""
    p = pattern.rstrip("\n").rstrip("\r")
    p = re.sub(r"(?<!\\)\s+$", "", p)
    if not p or p.startswith("#"):
        return None
    negate = p.startswith("!")
    p = p[1:] if negate else p
    p = p[1:] if p.startswith("\\") else p
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in p[i + 2 :]:
            z = p.index("]", i + 2)
            body = p[i + 1 : z].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", z + 1
        else:
            if c == "\\" and i + 1 < len(p):
                i += 1
                c = p[i]
            out, i = out + re.escape(c), i + 1
    start = re.escape(base + "/") if base else ""
    return f"^{start}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_dir else '(?:/.*)?'}$", negate


def ignore_rules(root: str) -> list[tuple[str, bool]]:
    """Rules of .git/info/exclude and of all .gitignore files, outer ones first; the last that matches decides."""
    rules = []
    exclude = os.path.join(root, ".git", "info", "exclude")
    files = [(exclude, "")] if os.path.isfile(exclude) else []
    for top, dirs, names in os.walk(root):
        rel = os.path.relpath(top, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        dirs[:] = sorted(d for d in dirs if d not in PRUNED)
        if ".gitignore" in names:
            files.append((os.path.join(top, ".gitignore"), rel))
    for path, base in files:
        with open(path, encoding="utf-8", errors="replace") as f:
            rules += [r for line in f if (r := ignore_regex(line, base))]
    return rules


def ignored(rel_path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for pattern, negate in rules:
        out = F.when(rel_path.rlike(pattern), F.lit(not negate)).otherwise(out)
    return out


def lossy_text(content) -> Column:
    """Text of bytes; invalid UTF-8 becomes U+FFFD and never fails."""
    return F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string"))


def discover_files(spark: SparkSession, path: str, *, max_file_kb: int = MAX_FILE_KB, extensions: list[str] | None = None, with_content: bool = True) -> DataFrame:
    """(rel_path, last_modified, length[, content]) of a tree, or of one file, whose root is then its directory.

    A missing path is an error.  Secret files are left out before their bytes are read.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    root = os.path.abspath(path if os.path.isdir(path) else os.path.dirname(path) or ".")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(os.path.abspath(path))
    # Spark's listing skips names that begin with "." or "_"; these are few, and are read by their own paths.
    hidden = [f for f in _hidden(path, root) if os.path.getsize(f) <= max_file_kb * 1024]
    if hidden:
        more = _read_paths(spark, hidden)
        files = more if not os.path.isdir(path) else files.unionByName(more)
    here = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/+", "/"), "^" + re.escape(root) + "/", "")
    rel = normal_path(F.url_decode(F.regexp_replace(here, r"\+", "%2B")))
    dirs = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    out = files.filter(F.col("length") <= max_file_kb * 1024).withColumn("rel_path", rel).filter(~skip_file(F.col("rel_path")))
    if os.path.isdir(path):
        out = out.filter(~F.arrays_overlap(dirs, F.array(*map(F.lit, PRUNED)))).filter(~ignored(F.col("rel_path"), ignore_rules(root)))
    if extensions is not None:
        out = out.filter(extension("rel_path").isin([x.lower().lstrip(".") for x in extensions]))
    cols = ["rel_path", F.unix_seconds("modificationTime").alias("last_modified"), "length"]
    return out.select(*cols, *(["content"] if with_content else [])).dropDuplicates(["rel_path"])


def _read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows that ``binaryFile`` gives, for files that it does not list."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            data = []
            for p in b.column(0).to_pylist():
                with open(p, "rb") as f:
                    data.append(f.read())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], ["path", "modificationTime", "length", "content"])

    rows = [(p, int(os.path.getmtime(p)), os.path.getsize(p)) for p in paths]
    listed = spark.createDataFrame(rows, "path string, at long, length long").select("path", F.timestamp_seconds("at").alias("modificationTime"), "length").filter(~skip_file("path"))
    return listed.mapInArrow(run, "path string, modificationTime timestamp, length long, content binary")


def _hidden(path: str, root: str) -> list[str]:
    if os.path.isfile(path):
        return [os.path.abspath(path)] if os.path.basename(path)[0] in "._" else []
    out = []
    for top, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in PRUNED]
        under = any(p[0] in "._" for p in os.path.relpath(top, root).split(os.sep) if p not in (".", ""))
        out += [os.path.join(top, n) for n in names if under or n[0] in "._"]
    return sorted(out)


def read_sources(spark: SparkSession, path: str, **options) -> DataFrame:
    """(rel_path, content text, last_modified)."""
    return discover_files(spark, path, **options).select("rel_path", lossy_text("content").alias("content"), "last_modified")


def table_sources(docs: DataFrame) -> DataFrame:
    """A text table (doc_id, text, source) as pseudo-files ``source/doc_id.md``."""
    return docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("rel_path"), F.coalesce("text", F.lit("")).alias("content"), F.lit(0).cast("long").alias("last_modified"))

"""Chunking of source files.

Sliding windows are built-in expressions.  Syntactic chunks need a parser: Python files go through the standard library's
``ast``, brace languages through a scanner, in Arrow batches; files without syntactic chunks fall back to windows.
"""

from __future__ import annotations

import ast
import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.secrets import contains_secret, skip_file
from quarry.functions.text import CODE_OVERLAP, CODE_WINDOW, chunk_id, content_hash, language_of, lines_of, shallow_id, shallow_projection, window_size

MAX_LINES, OVERLAP, HEADER = 200, 25, 5
BRACED = ("typescript", "tsx", "javascript", "jsx", "rust", "go")
COLUMNS = ["id", "content_hash", "rel_path", "start_line", "end_line", "symbol_name", "symbol_type", "language", "content", "last_modified"]


def sliding_chunks(files: DataFrame, *, window: int | None = None, step: int | None = None, doc_lines: int = 40) -> DataFrame:
    """(rel_path, last_modified, ordinal, start_line, end_line, content) of (rel_path, content, last_modified)."""
    size, every = (F.lit(window), F.lit(step)) if window else window_size("rel_path", doc_lines)
    df = files.withColumn("ls", lines_of("content")).withColumn("n", F.size("ls")).withColumn("w", size).withColumn("s", every).filter("n > 0")
    last = F.expr("((greatest(n - w, 0) + s - 1) div s) * s")
    df = df.select("rel_path", "last_modified", "ls", "n", "w", F.posexplode(F.sequence(F.lit(0), last.cast("int"), F.col("s"))).alias("ordinal", "start"))
    end = F.least(F.col("start") + F.col("w"), F.col("n"))
    return df.select("rel_path", "last_modified", "ordinal", (F.col("start") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("ls", F.col("start") + 1, end - F.col("start")), "\n").alias("content"))


def _split_node(text: str, first: int, name: str | None, kind: str, max_lines: int, overlap: int) -> list[tuple]:
    lines = text.splitlines() if "\r" not in text else re.split(r"\r?\n", text.rstrip("\r\n"))
    n = len(lines)
    if n <= max_lines:
        return [(first, first + n - 1, name, kind, text)] if n else []
    step = max(max_lines - min(max_lines * overlap // 100, max_lines - 1), 1)
    header, out = "\n".join(lines[:HEADER]), []
    for k, lo in enumerate(range(0, n, step)):
        hi = min(lo + max_lines, n)
        body = "\n".join(lines[lo:hi])
        out.append((first + lo, first + hi - 1, name, kind, f"{header}\n{body}" if k else body))
        if hi == n:
            break
    return out


def _python_nodes(source: str) -> list[tuple[int, int, str, str]]:
    """(start, end, name, kind) in bytes; a class gives its members, or itself where it has none."""
    data = source.encode()
    starts = [0]
    for line in data.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)

    def walk(node) -> list[tuple]:
        out = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((starts[child.lineno - 1] + child.col_offset, starts[child.end_lineno - 1] + child.end_col_offset, child.name, "function_definition"))
            elif isinstance(child, ast.ClassDef):
                out += walk(child) or [(starts[child.lineno - 1] + child.col_offset, starts[child.end_lineno - 1] + child.end_col_offset, child.name, "class_definition")]
            else:
                out += walk(child)
        return out

    return walk(ast.parse(source))


_HEADS = {
    "rust": [(r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)", "function_item", False), (r"(?:unsafe\s+)?impl\b[^;{]*", "impl_item", True), (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct_item", False)],
    "go": [(r"func\s+\([^)]*\)\s*(\w+)", "method_declaration", False), (r"func\s+(\w+)", "function_declaration", False)],
    "js": [(r"(?:async\s+)?function\s*\*?\s*([\w$]+)", "function_declaration", False), (r"(?:abstract\s+)?class\s+([\w$]+)", "class_declaration", True), (r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^>{]*>)?\([^{};]*\)\s*(?::[^{};=]+)?(?=\{)", "method_definition", False)],
}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "else", "do", "constructor_"}


def _blank(source: str, language: str) -> str:
    """The source with comments and string contents blanked, so that braces and keywords left are real."""
    quote = r"\"(?:\\.|[^\"\\])*\"" if language == "rust" else r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    char = r"|b?'(?:\\[^']*|[^'\\])'" if language == "rust" else ""
    raw = r"|r(#*)\".*?\"\1" if language == "rust" else r"|`(?:\\.|[^`\\])*`"
    pattern = re.compile(rf"//[^\n]*|/\*.*?\*/|{quote}{char}{raw}", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _braced_nodes(source: str, language: str) -> list[tuple[int, int, str | None, str]]:
    """Like _python_nodes, in characters; raises where braces do not match."""
    text = _blank(source, language)
    close, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif not stack:
            raise SyntaxError("unmatched brace")
        else:
            close[stack.pop()] = m.start()
    if stack:
        raise SyntaxError("unclosed brace")
    heads = [(re.compile(r"(?<![\w.$])" + p), kind, box) for p, kind, box in _HEADS.get(language, _HEADS["js"])]

    def scan(lo: int, hi: int, in_class: bool) -> list[tuple]:
        out, at = [], lo
        while at < hi:
            found = [(m.start(), i, m) for i, (p, kind, _) in enumerate(heads) if (kind != "method_definition" or in_class) and (m := p.search(text, at, hi))]
            if not found:
                break
            start, i, m = min(found, key=lambda x: (x[0], x[1]))
            _, kind, box = heads[i]
            name = m[1].strip() if m.re.groups and m[1] else None
            if kind == "method_definition" and name in _NOT_METHODS:
                at = m.start(1) + len(name)
                continue
            brace, semi = text.find("{", m.end(), hi), text.find(";", m.end(), hi)
            if kind == "struct_item" and semi >= 0 and (brace < 0 or semi < brace):
                out.append((start, semi + 1, name, kind))
                at = semi + 1
                continue
            if brace < 0 or (0 <= semi < brace and "[" not in text[m.end() : semi]):
                at = m.end()
                continue
            end = close[brace] + 1
            if kind == "impl_item":
                name = re.sub(r"^(?:unsafe\s+)?impl\s*(?:<[^>]*>)?\s*", "", text[start:brace]).split(" for ")[-1].strip()
                name = (re.match(r"\w+", name) or [None])[0]
            out += (scan(brace + 1, end - 1, kind == "class_declaration") if box else []) or [(start, end, name, kind)]
            at = end
        return out

    return scan(0, len(text), False)


def syntax_chunks(source: str, language: str | None, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> list[tuple]:
    """(start_line, end_line, symbol_name, symbol_type, content); none where the language is unknown or does not parse."""
    try:
        if language == "python":
            data = source.encode()
            nodes = [(data[:a].count(b"\n") + 1, data[a:z].decode(errors="replace"), name, kind) for a, z, name, kind in _python_nodes(source)]
        elif language in BRACED:
            ends = [m.start() for m in re.finditer("\n", source)]
            nodes = [(bisect.bisect_left(ends, a) + 1, source[a:z], name, kind) for a, z, name, kind in _braced_nodes(source, language)]
        else:
            return []
    except (SyntaxError, ValueError, RecursionError, KeyError):
        return []
    out = [x for first, text, name, kind in nodes for x in _split_node(text, first, name, kind, max_lines, overlap)]
    return sorted(out, key=lambda x: x[:2])


def window_chunks(source: str, size: int = CODE_WINDOW, overlap: int = CODE_OVERLAP) -> list[tuple]:
    """Windows of a code file that has no syntactic chunks, in the form of syntax_chunks."""
    if not source:
        return []
    lines = re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", source))
    step, out = max(size - min(size * overlap // 100, size - 1), 1), []
    for lo in range(0, len(lines), step):
        hi = min(lo + size, len(lines))
        out.append((lo + 1, hi, None, None, "\n".join(lines[lo:hi])))
        if hi == len(lines):
            break
    return out


def chunk_files(files: DataFrame, *, max_lines: int = MAX_LINES, overlap: int = OVERLAP, doc_lines: int = 40) -> DataFrame:
    """Chunk rows of files (rel_path, content, last_modified): syntactic where possible, else windows."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text, when, language in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found = syntax_chunks(text or "", language, max_lines, overlap) or window_chunks(text or "")
                rows += [(path, when, k, *c) for k, c in enumerate(found)]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["rel_path", "last_modified", "ordinal", "start_line", "end_line", "symbol_name", "symbol_type", "content"])

    schema = "rel_path string, last_modified long, ordinal int, start_line int, end_line int, symbol_name string, symbol_type string, content string"
    code = files.filter(language_of("rel_path").isNotNull())
    parsed = code.select("rel_path", "content", "last_modified", language_of("rel_path").alias("language")).mapInArrow(run, schema)
    windows = sliding_chunks(files.filter(language_of("rel_path").isNull()), doc_lines=doc_lines)
    windows = windows.withColumns({"symbol_name": F.lit(None).cast("string"), "symbol_type": F.lit(None).cast("string")})
    return finished(parsed.unionByName(windows))


def finished(chunks: DataFrame) -> DataFrame:
    """Identity and language: the storage contract of chunk rows, without vectors."""
    df = chunks.withColumn("content_hash", content_hash("content"))
    df = df.withColumn("id", chunk_id("rel_path", "symbol_name", "ordinal", "content_hash")).withColumn("language", F.coalesce(language_of("rel_path"), F.lit("unknown")))
    return df.select(*COLUMNS)


def shallow_documents(files: DataFrame) -> DataFrame:
    """One projected document per file for the keyword index."""
    df = files.withColumn("text", shallow_projection("rel_path", "content")).withColumn("content_hash", content_hash("text"))
    df = df.withColumn("id", shallow_id("rel_path", "content_hash"))
    return df.select("id", "content_hash", "rel_path", F.lit(1).alias("start_line"), F.greatest(F.size(lines_of("content")), F.lit(1)).alias("end_line"), F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("symbol_type"), F.coalesce(language_of("rel_path"), F.lit("unknown")).alias("language"), F.col("text").alias("content"), "last_modified")


def dump_chunks(files: DataFrame):
    """Printable lines of all chunks, one at a time and in order, for inspection only; nothing is stored.  Files and chunks with
    secrets are left out, as from an index."""
    rows = chunk_files(files.filter(~skip_file("rel_path"))).filter(~contains_secret("content"))
    for r in rows.orderBy("rel_path", "start_line", "end_line").toLocalIterator():
        yield f"{r.rel_path}:{r.start_line}-{r.end_line} {r.symbol_type or '-'} {r.symbol_name or '-'} {r.language}\n{r.content}"


__all__ = ["chunk_files", "dump_chunks", "finished", "shallow_documents", "sliding_chunks", "syntax_chunks"]

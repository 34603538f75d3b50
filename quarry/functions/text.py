"""Path, line, hash and label expressions.  All are built-in column expressions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "rs": "rust", "go": "go"}
DOC_EXTENSIONS = ["adoc", "asciidoc", "md", "markdown", "rst", "txt"]
DECLARATIONS = [
    "async fn ", "class ", "const ", "def ", "enum ", "export ", "fn ", "func ", "impl ", "interface ", "private ", "protected ",
    "pub async fn ", "pub const ", "pub enum ", "pub fn ", "pub struct ", "pub trait ", "public ", "struct ", "trait ", "type ",
]
CODE_WINDOW, CODE_OVERLAP, DOC_OVERLAP = 80, 25, 40
HEAD_LINES, TAIL_LINES = 50, 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(c) -> Column:
    """SHA-256 as hex."""
    return F.sha2(_c(c), 256)


def file_hash(c) -> Column:
    """The first 16 hex digits of the SHA-256 of a file's bytes."""
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def chunk_id(rel_path, symbol, ordinal, digest) -> Column:
    part = F.coalesce(_c(symbol), F.concat(F.lit("chunk_"), _c(ordinal).cast("string")))
    return F.sha2(F.concat_ws(":", _c(rel_path), part, _c(digest)), 256)


def shallow_id(rel_path, digest) -> Column:
    return F.sha2(F.concat_ws(":", F.lit("shallow"), _c(rel_path), _c(digest)), 256)


def normal_path(p) -> Column:
    return F.translate(_c(p), "\\", "/")


def file_name(p) -> Column:
    return F.regexp_extract(_c(p), r"([^/]*)$", 1)


def extension(p) -> Column:
    """Lower-cased last extension; names such as ``.env`` have none."""
    return F.lower(F.regexp_extract(_c(p), r"[^/]\.([^./]*)$", 1))


def stem(p) -> Column:
    return F.regexp_replace(file_name(p), r"(?<=.)\.[^.]*$", "")


def parent(p) -> Column:
    return F.regexp_extract(_c(p), r"^(.*)/[^/]+$", 1)


def parent_name(p) -> Column:
    return file_name(parent(p))


def directory(p) -> Column:
    """The parent directory, ``.`` at the top."""
    return F.when(parent(p) == "", ".").otherwise(parent(p))


def language_of(p) -> Column:
    """Language by extension, null where unknown."""
    e = extension(p)
    out = F.lit(None).cast("string")
    for k, v in reversed(LANGUAGES.items()):
        out = F.when(e == k, v).otherwise(out)
    return out


def lines_of(c) -> Column:
    """Lines without their ends; no empty line after the last end; none in an empty text."""
    c = _c(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n"))


def is_doc_path(p) -> Column:
    low = F.lower(_c(p))
    return low.startswith("docs/") | low.contains("/docs/") | extension(p).isin(DOC_EXTENSIONS)


def is_obvious_doc_path(p) -> Column:
    """Also a readme without extension."""
    low = F.lower(_c(p))
    return is_doc_path(p) | (low == "readme") | low.endswith("/readme")


def in_scope(p, scope: str) -> Column:
    p = _c(p)
    return (p == scope) | p.startswith(scope + "/")


def normal_scope(scope: str | None) -> str | None:
    return (scope or "").strip().replace("\\", "/").strip("/") or None


def window_size(p, doc_lines: int = 40) -> tuple[Column, Column]:
    """(lines, step) of the sliding window for a path."""
    doc = extension(p).isin("md", "txt", "rst")
    size = F.when(doc, F.lit(max(doc_lines, 1))).otherwise(F.lit(CODE_WINDOW))
    step = lambda n, pct: max(n - min(n * pct // 100, n - 1), 1)
    return size, F.when(doc, F.lit(step(max(doc_lines, 1), DOC_OVERLAP))).otherwise(F.lit(step(CODE_WINDOW, CODE_OVERLAP)))


def is_declaration(line) -> Column:
    return F.regexp_replace(_c(line), r"^\s+", "").rlike("^(" + "|".join(DECLARATIONS) + ")")


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it, inside of lambdas too."""
    return F.transform(F.array(value), f)[0]


def shallow_projection(rel_path, content) -> Column:
    """``path:`` line, then the first and last lines and all declarations, in order."""
    lines = lines_of(content)

    def chosen(s: Column) -> Column:
        marked = F.transform(s["lines"], lambda x, i: F.when((i < HEAD_LINES) | (i >= s["n"] - TAIL_LINES) | is_declaration(x), x))
        return F.filter(marked, lambda x: x.isNotNull())

    kept = let(let(lines, lambda x: F.struct(x.alias("lines"), F.size(x).alias("n"))), chosen)
    return F.concat(F.lit("path: "), _c(rel_path), F.lit("\n"), F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), ""))


def token_estimate(content, language) -> Column:
    """Ceiling of UTF-8 bytes over the language's bytes per token."""
    ratio = (
        F.when(_c(language).isin("python", "javascript", "typescript", "jsx", "tsx"), 3.5).when(_c(language).isin("rust", "go", "java"), 4.2).when(_c(language).isin("markdown", "md", "rst"), 4.8).otherwise(3.8)
    )
    return F.ceil(F.octet_length(_c(content)) / ratio).cast("long")


def line_range(start, end) -> Column:
    return F.format_string("%d-%d", _c(start), _c(end))


def percentage(part, whole) -> Column:
    """One decimal; 0 where the whole is 0."""
    return F.when(_c(whole) == 0, 0.0).otherwise(F.round(_c(part) / _c(whole) * 1000) / 10)


def result_mode(semantic, keyword) -> Column:
    s, k = _c(semantic).isNotNull(), _c(keyword).isNotNull()
    return F.when(s & k, "hybrid").when(s, "semantic").when(k, "keyword").otherwise("none")


def reason(semantic, keyword) -> Column:
    return F.concat(F.lit("Matched by "), result_mode(semantic, keyword), F.lit(" search"))


def trimmed(c) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")

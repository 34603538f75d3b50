"""From ranked chunks to a context package.

Rows carry query_id, id, rel_path, start_line, end_line, symbol_name, symbol_type, language, content, last_modified, score and
rank.  Filters, normalisation, related files, recency and summaries are relational; the merge of overlapping chunks is a
fold over sorted arrays in the JVM; the token budget is a per-query fold over at most a few thousand ranked rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.relevance import normalised, recency, similarity
from quarry.functions.text import directory, extension, in_scope, is_doc_path, is_obvious_doc_path, parent_name, percentage, stem
from quarry.functions.text import parent as parent_of
from quarry.functions.tokens import counter

# Fixed values.
HIGH, LOW, LEAST_SIMILARITY, MOST_FILES, MOST_CHUNKS, HUB = 0.6, 0.4, 0.3, 5, 3, 20
BARRELS = ["mod.rs", "index.ts", "index.tsx", "index.js", "index.jsx"]
RATIO = {"python": 3.5, "javascript": 3.5, "typescript": 3.5, "jsx": 3.5, "tsx": 3.5, "rust": 4.2, "go": 4.2, "java": 4.2, "markdown": 4.8, "md": 4.8, "rst": 4.8}


def first_files(results: DataFrame, most: int) -> DataFrame:
    """Rows of the first ``most`` distinct files of each query, in rank order."""
    first = F.min("rank").over(Window.partitionBy("query_id", "rel_path"))
    return results.withColumn("first_", first).withColumn("file_", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first_"))).filter(F.col("file_") <= most).drop("first_", "file_")


def filter_results(results: DataFrame, *, extensions: list[str] | None = None, include_docs: bool = True, scope: str | None = None, min_relevance: float = 0.0, max_files: int | None = None, limit: int | None = None) -> DataFrame:
    """Search post-filter: extension, docs, scope; then ``relevance`` over the survivors' best, threshold, files, limit."""
    df = results
    if extensions:
        df = df.filter(extension("rel_path").isin([x.lower().lstrip(".") for x in extensions]))
    if not include_docs:
        df = df.filter(~is_obvious_doc_path("rel_path"))
    if scope:
        df = df.filter(in_scope("rel_path", scope))
    df = df.withColumn("relevance", normalised("score", F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0).cast("float"))))
    df = df.filter(F.col("relevance") >= F.lit(min_relevance).cast("float"))
    if max_files is not None:
        df = first_files(df, max_files)
    if limit is not None:
        df = df.withColumn("n_", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("n_") <= limit).drop("n_")
    return df


def direct_results(results: DataFrame, *, include_docs: bool = True, scope: str | None = None, min_relevance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows with ``relevance``, (query_id, threshold_filtered)): normalised by the best of all input rows."""
    df = results.withColumn("relevance", normalised("score", F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0).cast("float"))))
    if not include_docs:
        df = df.filter(~is_doc_path("rel_path"))
    if scope:
        df = df.filter(in_scope("rel_path", scope))
    ok = F.col("relevance") >= F.lit(min_relevance).cast("float")
    return df.filter(ok), df.groupBy("query_id").agg(F.coalesce(F.bool_or(~ok), F.lit(False)).alias("threshold_filtered"))


def merge_overlaps(chunks: DataFrame) -> DataFrame:
    """Chunks of one file that overlap by more than half of the smaller span become one.

    Sorted by place, each chunk meets the running merged range; the better relevance (then the longer span, then the later
    start) gives content and rank, and the range grows.  The span test uses the merged range, so this is a fold, done with
    ``aggregate`` over one file's sorted chunks of one query.
    """
    body = [c for c in chunks.columns if c not in ("query_id", "rel_path", "start_line", "end_line", "rank")]
    item = F.struct("start_line", "end_line", "rank", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), F.struct(*body).alias("v"))
    rows = chunks.groupBy("query_id", "rel_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "rank", item.alias("x")))).alias("xs"))
    rows = rows.withColumn("xs", F.transform("xs", lambda s: s["x"]))
    span = lambda lo, hi: F.greatest(hi - lo + 1, F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        both = span(F.greatest(last["lo"], x["lo"]), F.least(last["hi"], x["hi"]))
        small = F.least(span(last["lo"], last["hi"]), span(x["lo"], x["hi"]))
        better = (x["v"]["relevance"] > last["v"]["relevance"]) | ((x["v"]["relevance"] == last["v"]["relevance"]) & ((span(x["lo"], x["hi"]) > span(last["lo"], last["hi"])) | ((span(x["lo"], x["hi"]) == span(last["lo"], last["hi"])) & (last["lo"] > x["lo"]))))
        kept = F.when(better, x).otherwise(last)
        merged = F.struct(kept["start_line"].alias("start_line"), kept["end_line"].alias("end_line"), kept["rank"].alias("rank"), F.least(last["lo"], x["lo"]).alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"), kept["v"].alias("v"))
        n = F.size(acc)
        return F.when((both > 0) & (small > 0) & (both * 2 > small), F.concat(F.slice(acc, 1, n - 1), F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    folded = F.aggregate(F.slice(F.col("xs"), 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.slice(F.col("xs"), 1, 1), step)
    out = rows.select("query_id", "rel_path", F.explode(folded).alias("m"))
    return out.select("query_id", "rel_path", F.col("m.lo").alias("start_line"), F.col("m.hi").alias("end_line"), F.col("m.rank").alias("rank"), "m.v.*").select(*chunks.columns)


def related_paths(results: DataFrame) -> DataFrame:
    """(query_id, path, multiplier, ord): test files and sibling barrels of result files, best tier first, not direct hits."""
    ext, name, box = extension_as_is("rel_path"), stem("rel_path"), parent_name("rel_path")
    js = ext.isin("js", "jsx", "ts", "tsx")
    far = (box != "") & ~box.isin("src", "tests", "test")
    f = lambda form, *c: F.format_string(form, *c)
    high = F.array(
        f("tests/test_%s.%s", name, ext), f("tests/%s_test.%s", name, ext), F.when(js, f("tests/%s.test.%s", name, ext)), F.when(far, f("tests/test_%s.%s", box, ext)), F.when(far, f("tests/%s_test.%s", box, ext)),
        F.when(far, f("tests/%s/test_%s.%s", box, name, ext)), F.when(far, f("tests/%s/%s_test.%s", box, name, ext)), F.when(far & js, f("tests/%s/%s.test.%s", box, name, ext)),
    )
    high = F.when(ext != "", F.array_distinct(F.array_compact(high))).otherwise(F.array().cast("array<string>"))
    up = parent_of("rel_path")
    low = F.array(*[F.when(up == "", F.lit(b)).otherwise(F.concat(up, F.lit("/" + b))) for b in BARRELS])
    each = lambda paths, tier, mult: results.select("query_id", "rank", F.posexplode(paths).alias("pos", "path")).select("query_id", "path", F.lit(mult).cast("float").alias("multiplier"), F.struct(F.lit(tier).alias("t"), "rank", "pos").alias("ord"))
    found = each(high, 0, HIGH).unionByName(each(low, 1, LOW)).groupBy("query_id", "path").agg(F.max("multiplier").alias("multiplier"), F.min("ord").alias("ord"))
    return found.join(results.select("query_id", F.col("rel_path").alias("path")).distinct(), ["query_id", "path"], "left_anti")


def extension_as_is(p: str) -> Column:
    return F.regexp_extract(p, r"[^/]\.([^./]*)$", 1)


def expand_related(results: DataFrame, chunks: DataFrame, vectors: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """Chunks of related files: per file the nearest three to the query's vector, similarity above the floor, at most five
    files.  ``vectors`` has query_id, query_vector; ``degree`` (path, n) leaves out hubs."""
    from quarry.functions.relevance import squared_l2

    paths = related_paths(results)
    if degree is not None:
        paths = paths.join(degree, "path", "left").filter(F.coalesce("n", F.lit(0)) <= HUB).drop("n")
    near = chunks.withColumnRenamed("rel_path", "path").join(paths, "path").join(vectors, "query_id").withColumn("distance", squared_l2("vector", "query_vector")).drop("vector", "query_vector")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "path").orderBy("distance", "id"))).filter(F.col("k") <= MOST_CHUNKS)
    near = near.withColumn("similarity", similarity("distance")).filter(F.col("similarity") > F.lit(LEAST_SIMILARITY).cast("float"))
    near = near.withColumn("file_", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("multiplier"), "ord", "path"))).filter(F.col("file_") <= MOST_FILES)
    return near.withColumn("relevance", (F.col("similarity") * F.col("multiplier")).cast("float")).withColumnRenamed("path", "rel_path").drop("k", "file_", "ord", "distance", "similarity")


def allocate(rows: list[dict], budget: int, max_files: int, count, join: str = "\n") -> list[dict]:
    """Chunks that fit the budget: estimates up to 90 %, a refill by exact counts below 95 %, then the last one cut."""
    if not rows or budget == 0:
        return []
    text = lambda chosen: join.join(r["content"] for r in chosen)
    limit, floor = max(1, -(-budget * 90 // 100)), -(-budget * 95 // 100)
    chosen, rest, files, used = [], [], set(), 0
    for r in rows:
        estimate = -(-len(r["content"].encode()) // 1) / RATIO.get(r["language"], 3.8)
        estimate = int(estimate) + (estimate != int(estimate))
        full = r["rel_path"] not in files and len(files) >= max_files
        if full or (chosen and used + estimate > limit):
            rest.append(r)
            continue
        used += estimate
        files.add(r["rel_path"])
        chosen.append(r)
    if not chosen:
        chosen.append(rest.pop(0))
        files.add(chosen[0]["rel_path"])
    exact = count(text(chosen))
    for r in rest:
        if exact >= floor:
            break
        if r["rel_path"] not in files and len(files) >= max_files:
            continue
        n = count(text([*chosen, r]))
        if n > budget:
            continue
        files.add(r["rel_path"])
        chosen.append(r)
        exact = n
    while chosen and count(text(chosen)) > budget:
        last, lo, hi = chosen[-1], 0, len(chosen[-1]["content"])
        head = chosen[:-1]
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if count(text([*head, last | {"content": last["content"][:mid]}])) <= budget:
                lo = mid
            else:
                hi = mid - 1
        chosen = [*head, last | {"content": last["content"][:lo]}] if lo else head
    return chosen


def allocate_budget(chunks: DataFrame, budget: int, max_files: int, rank_file: str | None = None) -> DataFrame:
    """Per query, the chunks of ``order`` (1..) that fit; adds ``place`` and the package's ``total_tokens``."""
    names = chunks.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", place int, total_tokens long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        count = counter(rank_file)
        rows = pdf.sort_values("order").to_dict("records")
        chosen = allocate(rows, budget, max_files, count)
        out = pd.DataFrame(chosen, columns=names)
        out["place"] = range(1, len(out) + 1)
        out["total_tokens"] = count("\n".join(r["content"] for r in chosen))
        return out

    return chunks.groupBy("query_id").applyInPandas(run, schema)


def confidence_of(n, top, above) -> Column:
    """Of a package: by the first chunk's relevance and how many reach the threshold."""
    return F.when((n == 0) | (top < 0.5) | (above < 2), "low").when((top > 0.8) & (above >= 3), "high").otherwise("medium")


def search_confidence(n, top) -> Column:
    return F.when((top > 0.8) & (n >= 3), "high").when((n > 0) & ((top >= 0.5) | (n >= 2)), "medium").otherwise("low")


def gap_reason(index_status, threshold_filtered, tokens, budget) -> Column:
    return F.when(index_status != "full", "index_incomplete").when(threshold_filtered, "threshold_filtered").when(tokens < budget, "no_more_relevant")


def clusters(chunks: DataFrame) -> DataFrame:
    """(query_id, prefix, n, avg_relevance) per directory, only where a query spans more than two."""
    g = chunks.groupBy("query_id", directory("rel_path").alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.avg("relevance").alias("avg_relevance"))
    return g.withColumn("dirs", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).filter("dirs > 2").drop("dirs")


def assemble(results: DataFrame, *, budget: int = 8000, max_files: int = 10, min_relevance: float = 0.5, include_docs: bool = True, scope: str | None = None, deduplicate: bool = True, related: tuple[DataFrame, DataFrame] | None = None, include_related: bool = True, now: int = 0, index_status: str = "full", coverage_pct: float = 100.0, rank_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(package rows, one metadata row per query).  ``related`` is (chunks with vectors, (query_id, query_vector))."""
    asked = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("direct_results"))
    direct, dropped = direct_results(results, include_docs=include_docs, scope=scope, min_relevance=min_relevance)
    before = direct.groupBy("query_id").agg(F.count(F.lit(1)).alias("before"))
    if deduplicate:
        direct = merge_overlaps(direct)
    after = direct.groupBy("query_id").agg(F.count(F.lit(1)).alias("after"))
    cols = ["query_id", "id", "rel_path", "start_line", "end_line", "symbol_name", "symbol_type", "language", "content", "last_modified", "relevance"]
    rows = direct.select(*cols, F.lit("search").alias("source"))
    if include_related and related is not None:
        more = expand_related(direct.select("query_id", "rel_path", "rank"), related[0], related[1])
        rows = rows.unionByName(more.select(*cols, F.lit("related").alias("source")))
    rows = rows.withColumn("relevance", recency("relevance", "last_modified", now))
    rows = rows.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rel_path", "start_line", "end_line")))
    package = allocate_budget(rows, budget, max_files, rank_file)
    per = package.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chunks_returned"), F.countDistinct("rel_path").alias("files_included"), F.array_sort(F.collect_set("rel_path")).alias("files"), F.max("total_tokens").alias("total_tokens"),
        F.min_by("relevance", "place").alias("top"), F.count_if(F.col("relevance") >= min_relevance).alias("above"), F.count_if(F.col("source") == "related").alias("expanded_results"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    meta = asked.join(dropped, "query_id", "left").join(before, "query_id", "left").join(after, "query_id", "left").join(per, "query_id", "left")
    groups = clusters(package).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("prefix", "n", "avg_relevance"))).alias("clusters"))
    meta = meta.join(groups, "query_id", "left")
    status = F.lit(index_status)
    warnings = F.array_distinct(F.array_compact(F.array(
        F.when(status == "empty", "index is empty").when(status != "full", "index is incomplete; results may miss files"),
        F.when(zero("before") > zero("after"), F.format_string("%d overlapping chunks were merged", zero("before") - zero("after"))),
        F.when(F.lit(include_related and related is None), "related files were not searched"),
    )))
    confidence = confidence_of(zero("chunks_returned"), F.coalesce("top", F.lit(0.0)), zero("above"))
    meta = meta.select(
        "query_id", zero("files_included").alias("files_included"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), zero("total_tokens").alias("total_tokens"), percentage(zero("total_tokens"), F.lit(budget)).alias("budget_used_pct"),
        zero("chunks_returned").alias("chunks_returned"), (zero("before") - zero("after")).alias("chunks_deduplicated"), "direct_results", zero("expanded_results").alias("expanded_results"), F.lit(False).alias("cache_hit"), status.alias("index_status"), F.lit(coverage_pct).alias("index_coverage_pct"),
        confidence.alias("result_confidence"), gap_reason(status, F.coalesce("threshold_filtered", F.lit(False)), zero("total_tokens"), F.lit(budget)).alias("budget_gap_reason"), warnings.alias("missing_context_warnings"),
        F.when(status != "full", "finish indexing, then ask again").when(zero("chunks_returned") == 0, "broaden the query or lower min_relevance").when(confidence == "low", "refine the query with symbol or file names").alias("suggested_action"), "clusters",
    )
    return package, meta


def to_wire(package: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, json): chunks in order and metadata as one document per query."""
    shown = F.struct(
        "place", F.col("rel_path").alias("file"), F.format_string("%d-%d", "start_line", "end_line").alias("lines"), F.col("symbol_name").alias("symbol"), F.col("symbol_type").alias("type"), "language",
        F.least(F.greatest(F.col("relevance"), F.lit(0.0)), F.lit(1.0)).alias("relevance"), "source", F.when(F.col("source") == "related", "Related file").otherwise("Matched by search").alias("reason"), "content",
    )
    rows = package.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("chunks"))
    return meta.join(rows, "query_id", "left").select("query_id", F.to_json(F.struct(F.coalesce("chunks", F.array().cast(rows.schema["chunks"].dataType)).alias("chunks"), F.struct(*[c for c in meta.columns if c != "query_id"]).alias("metadata"))).alias("json"))

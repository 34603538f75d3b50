"""Entry points: index a code base, search it, and build context for a prompt."""

from __future__ import annotations

import hashlib
import os
import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.relevance import candidate_limit
from quarry.functions.synonyms import query_terms
from quarry.functions.text import extension, file_hash, in_scope, is_doc_path, normal_scope, reason, trimmed
from quarry.operators.context import assemble, filter_results, search_confidence, to_wire
from quarry.operators.fusion import hydrate, query_weights, rrf_fuse
from quarry.operators.keyword import keyword_search, top_k, words_of
from quarry.operators.vector import search_vectors
from quarry.plans.indexing import coverage, index_files, index_shallow
from quarry.plans.store import Store, buckets_for
from quarry.sources.embedders import HashEmbedder, prefixes
from quarry.sources.files import discover_files, read_sources

MODES = ("hybrid", "semantic", "keyword")
HEALTH_SECONDS = 30


class QueryCache:
    """Least recently used results with a time to live; entries go when one of their files changes."""

    def __init__(self, size: int = 100, ttl: float = 60.0, clock=time.monotonic):
        self.size, self.ttl, self.clock, self.kept = size, ttl, clock, OrderedDict()

    @staticmethod
    def key(query: str, mode: str, project: str, *more) -> tuple:
        return (query.strip(), mode, project, *more)

    def get(self, key: tuple):
        if key not in self.kept:
            return None
        value, _, at = self.kept[key]
        if self.clock() - at > self.ttl:
            del self.kept[key]
            return None
        self.kept.move_to_end(key)
        return value

    def put(self, key: tuple, value, files: set[str]) -> None:
        self.kept[key] = (value, set(files), self.clock())
        self.kept.move_to_end(key)
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)

    def invalidate_file(self, path: str) -> int:
        gone = [k for k, (_, files, _) in self.kept.items() if path in files]
        for k in gone:
            del self.kept[k]
        return len(gone)

    def clear(self) -> None:
        self.kept.clear()


def project_key(root: str) -> str:
    return hashlib.sha256(os.path.realpath(root).encode()).hexdigest()


def _whole(name: str, value, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")
    return value


def _words(value, name: str = "query") -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text that is not blank")
    return value.strip()


def parse_search(args: dict) -> dict:
    mode = args.get("mode", "hybrid")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    ext = args.get("filter_ext") or []
    if not isinstance(ext, list) or not all(isinstance(e, str) for e in ext):
        raise ValueError("filter_ext must be a list of texts")
    return {"query": _words(args.get("query")), "path": _words(args.get("path"), "path"), "top_k": _whole("top_k", args.get("top_k", 8)), "mode": mode, "filter_ext": ext, "bypass_cache": bool(args.get("bypass_cache", False))}


def parse_context(args: dict) -> dict:
    least = args.get("min_relevance", 0.5)
    if isinstance(least, bool) or not isinstance(least, (int, float)) or not 0 <= least <= 1:
        raise ValueError("min_relevance must be within 0 and 1")
    return {
        "query": _words(args.get("query")), "path": _words(args.get("path"), "path"), "token_budget": _whole("token_budget", args.get("token_budget", 8000)), "max_files": _whole("max_files", args.get("max_files", 10)),
        "include_related": bool(args.get("include_related", True)), "include_docs": bool(args.get("include_docs", True)), "min_relevance": float(least), "scope": normal_scope(args.get("scope")), "bypass_cache": bool(args.get("bypass_cache", False)),
    }


def search(store: Store, queries: DataFrame, k: int, embedder, *, mode: str = "hybrid", expand: bool = True, filters=None) -> DataFrame:
    """Ranked, hydrated results of many queries (query_id, query).

    Both legs take ``filters`` before their cut, so neither over-fetches.  Blank queries and k = 0 give nothing.
    """
    queries = queries.filter(trimmed("query") != "")
    limit = candidate_limit(k)
    index = store.index()
    semantic = keyword = None
    if mode != "keyword":
        texts = queries.toPandas()  # a stated, small set; its vectors are size-checked by the operator
        rows = [(q, v.tolist()) for q, v in zip(texts["query_id"], embedder.embed([prefixes(embedder.name)[1] + t for t in texts["query"]]), strict=True)]
        vectors = queries.sparkSession.createDataFrame(rows, f"query_id {queries.schema['query_id'].dataType.simpleString()}, vector array<float>")
        semantic = search_vectors(store.chunks, vectors, limit, filters=filters)
    if mode != "semantic":
        terms = query_terms(queries) if expand else queries.select("query_id", F.explode(words_of("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))
        keyword = keyword_search(index, terms, limit, filters=filters)
    if mode == "hybrid":
        ranked = rrf_fuse(semantic, keyword, query_weights(queries))
    elif mode == "semantic":
        from quarry.functions.relevance import similarity

        ranked = semantic.select("query_id", "id", similarity("distance").alias("score"), similarity("distance").alias("semantic_score"), F.lit(None).cast("float").alias("keyword_score"))
    else:
        ranked = keyword.select("query_id", "id", F.col("score").cast("float").alias("score"), F.lit(None).cast("float").alias("semantic_score"), F.col("score").cast("float").alias("keyword_score"))
    return hydrate(top_k(ranked, k), store.chunks.drop("vector"), index["docs"])


@dataclass
class Engine:
    spark: SparkSession
    data_dir: str
    embedder: object = field(default_factory=HashEmbedder)
    rank_file: str | None = None
    cache: QueryCache = field(default_factory=QueryCache)
    clock: object = time.time
    chunking: dict = field(default_factory=dict)
    max_file_size_kb: int | None = None
    health: dict = field(default_factory=dict)

    def root(self, path: str) -> str:
        return f"{self.data_dir}/{project_key(path)}"

    def store(self, path: str) -> Store:
        return Store.open(self.spark, self.root(path), model=self.embedder.name, dim=self.embedder.dim)

    def sources(self, path: str, extensions: list[str] | None = None) -> DataFrame:
        return read_sources(self.spark, path, extensions=extensions, **self._limits())

    def _limits(self) -> dict:
        return {} if self.max_file_size_kb is None else {"max_file_kb": self.max_file_size_kb}

    def index_codebase(self, path: str, force_full: bool = False, extensions: list[str] | None = None) -> dict:
        try:
            files = self.sources(path, extensions)
            size = discover_files(self.spark, path, extensions=extensions, with_content=False, **self._limits()).agg(F.sum("length")).first()[0]
            store = Store.open_or_create(self.spark, self.root(path), model=self.embedder.name, dim=self.embedder.dim, buckets=buckets_for(size or 0))
            whole = os.path.isdir(path) and extensions is None
            if whole:
                index_shallow(files, store)
            out = index_files(files, store, self.embedder, force=force_full, complete=whole, now=int(self.clock()), **self.chunking)
            self.cache.clear()
            self.health.clear()
            return out
        except (OSError, ValueError) as e:
            return {"status": "error", "error": str(e)}

    def status(self, path: str) -> dict:
        """Coverage of the tree as it was at most HEALTH_SECONDS ago."""
        known = self.health.get(path)
        if known is not None and self.clock() - known[0] < HEALTH_SECONDS:
            return known[1]
        store = self.store(path)
        files = self.sources(path).withColumn("hash", file_hash(F.col("content").cast("binary")))
        row = coverage(files, store.table("state"), store.manifest["phase"] == "full").first()
        out = row.asDict() | {"phase": store.manifest["phase"]}
        self.health[path] = (self.clock(), out)
        return out

    def search_code(self, **args) -> dict:
        try:
            began, a = time.monotonic(), parse_search(args)
            store = self.store(a["path"])
            phase = store.manifest["phase"]
            mode = "keyword" if phase == "partial" else a["mode"]
            key = QueryCache.key(a["query"], mode, self.root(a["path"]), a["top_k"], tuple(a["filter_ext"]))
            hit = None if a["bypass_cache"] else self.cache.get(key)
            cached = hit is not None
            if not cached:
                ext = [e.lower().lstrip(".") for e in a["filter_ext"]]
                queries = self.spark.createDataFrame([(0, a["query"])], "query_id int, query string")
                found = search(store, queries, a["top_k"], self.embedder, mode=mode, expand=phase == "full", filters=extension("rel_path").isin(ext) if ext else None)
                rows = filter_results(found, limit=a["top_k"]).withColumn("reason", reason("semantic_score", "keyword_score")).orderBy("rank").collect()
                hit = [{"chunk_id": r.id, "file": r.rel_path, "lines": f"{r.start_line}-{r.end_line}", "symbol": r.symbol_name, "type": r.symbol_type, "language": r.language, "score": r.relevance, "reason": r.reason, "snippet": r.content} for r in rows]
                self.cache.put(key, hit, {h["file"] for h in hit})
            n, top = len(hit), max([h["score"] for h in hit], default=0.0)
            confidence = "high" if top > 0.8 and n >= 3 else "medium" if n and (top >= 0.5 or n >= 2) else "low"
            return {"results": hit, "metadata": {"search_time_ms": int((time.monotonic() - began) * 1000), "mode": mode, "cache_hit": cached, "index_status": phase, "result_confidence": confidence, "missing_context_warnings": [] if phase == "full" else ["index is incomplete; results may miss files"]}}
        except (OSError, ValueError) as e:
            return {"status": "error", "error": str(e)}

    def get_context_for_prompt(self, **args) -> dict:
        import json

        try:
            a = parse_context(args)
            store = self.store(a["path"])
            phase = store.manifest["phase"]
            key = QueryCache.key(a["query"], "context", self.root(a["path"]), phase, *(v for k, v in sorted(a.items()) if k not in ("query", "path", "bypass_cache")))
            hit = None if a["bypass_cache"] else self.cache.get(key)
            if hit is not None:
                hit = json.loads(hit)
                hit["metadata"]["cache_hit"] = True
                return hit
            queries = self.spark.createDataFrame([(0, a["query"])], "query_id int, query string")
            filters = None if a["include_docs"] else ~is_doc_path("rel_path")
            if a["scope"]:
                filters = in_scope("rel_path", a["scope"]) if filters is None else filters & in_scope("rel_path", a["scope"])
            found = search(store, queries, max(a["max_files"] * 4, 8), self.embedder, mode="hybrid" if phase == "full" else "keyword", expand=phase == "full", filters=filters)
            related = None
            if a["include_related"] and phase == "full":
                vector = self.embedder.embed([prefixes(self.embedder.name)[1] + a["query"]])[0].tolist()
                related = (store.chunks, self.spark.createDataFrame([(0, vector)], "query_id int, query_vector array<float>"))
            package, meta = assemble(found, budget=a["token_budget"], max_files=a["max_files"], min_relevance=a["min_relevance"], include_docs=a["include_docs"], scope=a["scope"], include_related=a["include_related"], related=related, now=int(self.clock()), index_status=phase, rank_file=self.rank_file)
            row = to_wire(package, meta).first()
            out = json.loads(row.json) if row else {"chunks": [], "metadata": {"chunks_returned": 0, "cache_hit": False, "index_status": phase, "result_confidence": "low"}}
            self.cache.put(key, json.dumps(out), {c["file"] for c in out["chunks"]})
            return out
        except (OSError, ValueError) as e:
            return {"status": "error", "error": str(e)}


__all__ = ["Engine", "QueryCache", "parse_context", "parse_search", "project_key", "search", "search_confidence"]

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quarry.plans.config import load_config
from quarry.plans.engine import Engine, QueryCache, parse_context, parse_search
from quarry.plans.indexing import index_files
from quarry.plans.store import Store
from quarry.sources.embedders import HashEmbedder, HttpEmbedder, build_embedder
from quarry.sources.files import discover_files, ignore_regex
from quarry.sources.fixtures import validate_fixture
from quarry.streaming.changes import reindex_stream

FILE = "rel_path string, content string, last_modified long"


def write(root, **files):
    for name, body in files.items():
        p = os.path.join(root, name.replace("__", "/"))
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())


def tree(tmp_path):
    root = tmp_path / "code"
    for path, body in {"src/auth.py": "def login(user):\n    return validate_token(user)\n", "src/db.py": "def connect():\n    return 'database'\n", "tests/test_auth.py": "def test_login():\n    assert login('x')\n", ".env": "SECRET=1", "node_modules/x.js": "function x() {}", ".gitignore": "*.log\nbuild2/\n!keep.log\n", "a.log": "x", "keep.log": "y", "build2/z.py": "z = 1", "README.md": "# Login service\n", "bad.txt": b"\xff\xfeok"}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


def test_discovery(spark, tmp_path):
    root = tree(tmp_path)
    got = sorted(r.rel_path for r in discover_files(spark, root, with_content=False).collect())
    assert got == [".gitignore", "README.md", "bad.txt", "keep.log", "src/auth.py", "src/db.py", "tests/test_auth.py"]
    assert [r.rel_path for r in discover_files(spark, root, extensions=["PY"]).orderBy("rel_path").collect()] == ["src/auth.py", "src/db.py", "tests/test_auth.py"]
    assert [r.rel_path for r in discover_files(spark, root + "/src/db.py").collect()] == ["db.py"]
    assert discover_files(spark, root, max_file_kb=0).count() == 0
    with pytest.raises(FileNotFoundError):
        discover_files(spark, root + "/none")


def test_ignore_patterns():
    import re

    def hit(pattern, path, base=""):
        return bool(re.search(ignore_regex(pattern, base)[0], path))

    assert hit("*.log", "a/b.log") and not hit("/x", "a/x") and hit("a/**/b", "a/b") and hit("a/**/b", "a/x/y/b") and hit("d/", "q/d/x") and hit("[ab].c", "a.c") and hit("x", "sub/x", "sub") and not hit("x", "x", "sub")
    assert ignore_regex("# c") is None and ignore_regex("!k")[1]


def test_engine(spark, tmp_path):
    root = tree(tmp_path)
    e = Engine(spark, str(tmp_path / "data"), HashEmbedder(32), cache=QueryCache(ttl=1e9), clock=lambda: 1_700_000_000)
    assert "error" in e.search_code(query="login", path=root)
    first = e.index_codebase(root)
    assert first["files"] == 7 and first["changed"] == 7 and first["chunks"] == first["embeddings"] + first["reused"]
    assert e.index_codebase(root)["changed"] == 0
    assert e.status(root)["status"] == "full"
    out = e.search_code(query="login validate_token", path=root, top_k=3)
    assert out["results"][0]["file"] == "src/auth.py" and out["results"][0]["score"] == 1.0 and out["metadata"]["mode"] == "hybrid"
    assert {r["file"] for r in e.search_code(query="login", path=root, mode="keyword", filter_ext=["md"])["results"]} == {"README.md"}
    assert e.search_code(query="login", path=root, mode="semantic")["results"]
    ctx = e.get_context_for_prompt(query="login user", path=root, token_budget=200, min_relevance=0.1)
    assert ctx["metadata"]["total_tokens"] <= 200 and ctx["chunks"][0]["file"]
    assert ctx["metadata"]["cache_hit"] is False
    same = e.get_context_for_prompt(query=" login user ", path=root, token_budget=200, min_relevance=0.1)
    assert same["metadata"]["cache_hit"] is True and same["chunks"] == ctx["chunks"]
    assert e.search_code(query="login", path=root, mode="semantic")["metadata"]["cache_hit"] is True
    os.remove(f"{root}/src/db.py")
    with open(f"{root}/src/auth.py", "a") as f:
        f.write("\ndef logout():\n    pass\n")
    again = e.index_codebase(root)
    assert again["changed"] == 1 and again["removed"] == 1 and again["reused"] == 1
    assert not e.store(root).chunks.filter("rel_path = 'src/db.py'").count()
    with pytest.raises(ValueError):
        Store.open(spark, e.root(root), dim=99)


def test_store_and_recovery(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"), model="hashing", dim=16, buckets=4)
    files = spark.createDataFrame([(f"d/{i}.md", f"text number {i}", 1) for i in range(20)] + [("it's.md", "quote", 1)], FILE)
    e = HashEmbedder(16)
    index_files(files, store, e, now=5)
    assert store.chunks.count() == 21 and store.manifest["phase"] == "full" and store.pending().count() == 0
    one = spark.createDataFrame([("it's.md",)], "rel_path string")
    assert store.delete_by_files(one) == 1 and store.delete_by_files(one) == 0 and store.chunks.count() == 20
    store.set_status(spark.createDataFrame([("d/1.md", "x")], "rel_path string, hash string"), "pending")
    assert index_files(files, store, e)["changed"] == 1
    bad = store.chunks.limit(1).withColumn("vector", __import__("pyspark.sql.functions", fromlist=["x"]).array().cast("array<float>"))
    with pytest.raises(Exception, match="dimensions"):
        store.insert_chunks(bad)
    assert Store.open(spark, str(tmp_path / "s")).chunks.count() == 20


def test_buckets_follow_the_sources(spark, tmp_path):
    """A store that outgrows its buckets is dealt anew with the same rows, takes changes as before, and leaves no work tables."""
    from quarry.plans.store import BUCKET_BYTES, LEAST_BUCKETS, TABLES, buckets_for

    assert buckets_for(0) == LEAST_BUCKETS and buckets_for(100 * BUCKET_BYTES + 1) == 101
    root, e = str(tmp_path / "s"), HashEmbedder(8)
    files = spark.createDataFrame([(f"d/{i}.md", f"text number {i}", 1) for i in range(30)], FILE)
    store = Store.create(spark, root, model=e.name, dim=8, buckets=2)
    index_files(files, store, e, now=5)
    before = {t: sorted(map(str, store.table(t).collect())) for t in TABLES}
    assert Store.open_or_create(spark, root, model=e.name, dim=8, buckets=4).manifest["n_buckets"] == 2
    store = Store.open_or_create(spark, root, model=e.name, dim=8, buckets=7)
    assert store.manifest["n_buckets"] == 7 and set(store.manifest["tables"]["chunks"]) == {str(b) for b in store.buckets_of(files)}
    assert {t: sorted(map(str, store.table(t).collect())) for t in TABLES} == before
    store.optimize()
    assert index_files(files, store, e)["changed"] == 0
    assert index_files(files.filter("rel_path != 'd/3.md'"), store, e)["removed"] == 1 and store.chunks.count() == 29
    assert not os.path.exists(f"{root}/work") or not os.listdir(f"{root}/work")


def test_stream(spark, tmp_path):
    src, root = str(tmp_path / "changes"), str(tmp_path / "store")
    schema = "rel_path string, ts timestamp, content string"
    spark.sql("select 'a.md' as rel_path, timestamp'2024-01-01 00:00:00' as ts, 'old' as content union all select 'a.md', timestamp'2024-01-01 00:00:01', 'new text' union all select 'b.md', timestamp'2024-01-01 00:00:00', 'other'").write.parquet(src)
    e = HashEmbedder(8)
    reindex_stream(spark.readStream.schema(schema).parquet(src), root, e, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.content for r in Store.open(spark, root).chunks.collect()) == ["new text", "other"]
    spark.sql("select 'b.md' as rel_path, timestamp'2024-01-02 00:00:00' as ts, cast(null as string) as content").write.mode("append").parquet(src)
    reindex_stream(spark.readStream.schema(schema).parquet(src), root, e, str(tmp_path / "cp")).awaitTermination()
    assert [r.rel_path for r in Store.open(spark, root).chunks.collect()] == ["a.md"]


def test_stream_waits_for_quiet(spark, tmp_path):
    """A burst is indexed once, with its last text; a file that has not been quiet yet waits."""
    src, root = str(tmp_path / "changes"), str(tmp_path / "store")
    schema = "rel_path string, ts timestamp, content string"
    for i, (path, ts, text) in enumerate([("a.md", "00:00:00.0", "first"), ("a.md", "00:00:00.1", "last"), ("b.md", "01:00:00.0", "other"), ("c.md", "01:00:30.0", "late")]):
        spark.sql(f"select '{path}' as rel_path, timestamp'2024-01-01 {ts}' as ts, '{text}' as content").coalesce(1).write.parquet(f"{src}/{i}")
    e = HashEmbedder(8)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    reindex_stream(read, root, e, str(tmp_path / "cp"), quiet="200 milliseconds").awaitTermination()
    assert {r.content for r in Store.open(spark, root).chunks.collect()} == {"last", "other"}


def test_blank_queries(spark, tmp_path):
    """White space of any kind is blank."""
    from quarry.plans.engine import search

    store = Store.create(spark, str(tmp_path / "s"), model="hashing", dim=8, buckets=2)
    index_files(spark.createDataFrame([("a.md", "some words", 1)], FILE), store, HashEmbedder(8))
    q = spark.createDataFrame([(0, "\u00a0\t "), (1, "words")], "query_id int, query string")
    assert {r.query_id for r in search(store, q, 3, HashEmbedder(8)).collect()} == {1}


def test_settings_reach_the_backend(tmp_path):
    config = load_config(env={"QUARRY__EMBEDDING__BACKEND": "openai", "QUARRY__EMBEDDING__MODEL": "m", "QUARRY__EMBEDDING__API_KEY": "k", "QUARRY__EMBEDDING__DIM": "7", "QUARRY__INDEX__CHUNK_MAX_LINES": "9"})
    e = build_embedder(config.embedding.backend, **config.embedding.options())
    assert (e.name, e.dim, e.api_key) == ("m", 7, "k") and e.base_url.startswith("https://") and config.index.chunking()["max_lines"] == 9
    assert build_embedder("ollama", model="m", dim=3, base_url="http://x").base_url == "http://x"
    config = load_config(env={"QUARRY__EMBEDDING__BACKEND": "onnx"})
    with pytest.raises(FileNotFoundError, match="folder"):
        build_embedder(config.embedding.backend, **config.embedding.options())
    assert config.watch.quiet == "200 milliseconds"


def test_cache():
    now = [0.0]
    c = QueryCache(2, 60, lambda: now[0])
    k = QueryCache.key(" q ", "hybrid", "p")
    c.put(k, 1, {"a"})
    assert c.get(QueryCache.key("q", "hybrid", "p")) == 1
    now[0] = 60.0
    assert c.get(k) == 1
    now[0] = 60.1
    assert c.get(k) is None
    for i in range(3):
        c.put((i,), i, {str(i)})
    assert c.get((0,)) is None and c.invalidate_file("2") == 1 and c.get((2,)) is None and c.get((1,)) == 1


def test_arguments():
    assert parse_search({"query": " x ", "path": "."})["query"] == "x"
    assert parse_context({"query": "x", "path": ".", "scope": "/src/"})["scope"] == "src"
    for bad in ({"path": "."}, {"query": " ", "path": "."}, {"query": "x", "path": ".", "top_k": 0}, {"query": "x", "path": ".", "mode": "z"}, {"query": "x", "path": ".", "top_k": True}):
        with pytest.raises(ValueError):
            parse_search(bad)
    with pytest.raises(ValueError):
        parse_context({"query": "x", "path": ".", "min_relevance": 1.5})


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[index]\nchunk_max_lines = 50\n[embedding]\nbackend = 'onnx'\n")
    c = load_config(str(p), {"QUARRY__INDEX__CHUNK_MAX_LINES": "60"})
    assert c.index.chunk_max_lines == 60 and c.embedding.backend == "onnx" and c.index.doc_chunk_max_lines == 40
    assert "secret" not in repr(load_config(env={"QUARRY__EMBEDDING__API_KEY": "secret"}))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.toml"))


def test_http_embedder():
    replies = [429, 500, 200]

    class H(BaseHTTPRequestHandler):
        def do_POST(self):
            n = len(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"])
            code = replies.pop(0)
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(n))]}).encode())
            else:
                self.wfile.write(b"denied k-secret")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    waits = []
    e = HttpEmbedder(f"http://127.0.0.1:{server.server_port}/v1", "m", 2, api_key="k-secret", sleep=waits.append)
    assert e.embed(["a", "b"]).tolist() == [[0.0, 1.0], [1.0, 1.0]] and waits == [0.5, 1.0]
    replies.append(401)
    with pytest.raises(ValueError, match="401") as x:
        e.embed(["a"])
    assert "k-secret" not in str(x.value)
    server.shutdown()


def test_embedders():
    e = build_embedder("onnx", model="m", fallback="hash", folder="/none")
    assert e.name == "hashing" and abs((e.embed(["some words"]) ** 2).sum() - 1) < 1e-6 and not e.embed([""]).any()
    with pytest.raises(FileNotFoundError):
        build_embedder("onnx", model="m", folder="/none")


def test_fixture(spark):
    corpus = spark.createDataFrame([("a", "x")], "rel_path string, content string")
    good = spark.createDataFrame([("q", "x", ["a"])], "query_id string, query string, relevant array<string>")
    validate_fixture(corpus, good)
    for bad in ([("q", "x", ["b"])], [("q", "x", [])]):
        with pytest.raises(ValueError):
            validate_fixture(corpus, spark.createDataFrame(bad, good.schema))


def test_a_change_writes_what_changed(spark, tmp_path, monkeypatch):
    """A change adds its own rows only, texts are not kept twice, and a bucket of many versions is rewritten with the same rows."""
    from quarry.plans import store as S

    root, e = str(tmp_path / "s"), HashEmbedder(8)
    store = Store.create(spark, root, model=e.name, dim=8, buckets=1)
    index_files(spark.createDataFrame([(f"d/{i}.md", f"text number{i}", 1) for i in range(9)], FILE), store, e)
    index_files(spark.createDataFrame([("d/3.md", "other words", 1)], FILE), store, e, complete=False)
    versions = store.manifest["tables"]["chunks"]["0"]
    assert spark.read.parquet(f"{root}/chunks/v{versions[-1]}").count() == 1 and not store.manifest["tables"]["texts"]
    monkeypatch.setattr(S, "MOST_VERSIONS", 1)
    names = {t: sorted(map(str, store.table(t).collect())) for t in S.TABLES}
    assert len(names["chunks"]) == len(names["texts"]) == 9 and not [x for x in names["postings"] if "number3" in x]
    store._compact([0])
    assert len(store.manifest["tables"]["chunks"]["0"]) == 1 and {t: sorted(map(str, store.table(t).collect())) for t in S.TABLES} == names

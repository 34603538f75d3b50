import hashlib
import random

import duckdb
import numpy as np

from quarry.llm import chat as C
from quarry.llm import urls as U
from quarry.llm import warc as W
from quarry.llm.common import new_path

PAGES = "page_id long, url string, html string, key string, file int"


def pages(spark):
    rows = [(i, f"https://{'www.' if i % 2 else ''}h{i % 5}.example.com/p/{i}?q=é x", f"<p>{i % 7}</p>" if i % 3 else "é" * i, None, 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "no scheme", "", None, None), (102, "https://a.b", "", None, None), (None, "https://n.example.com/", "only", None, None), (-5, "https://n.example.com/", "<p>1</p>", None, None), (3, rows[3][1], rows[3][2], None, None)]
    return spark.createDataFrame(rows, PAGES).repartition(3), rows


def archive(df, **options):
    root = new_path(df.sparkSession, "t-warc")
    captures = W.write_archives(df, root, **options)
    return root, captures, W.write_index(captures, root, block_rows=3)


def test_round_trip(spark):
    df, rows = pages(spark)
    root, captures, index = archive(df)
    found = W.lookup(captures.select("key").distinct(), index, root)
    got = W.resolve(W.read_records(found, root)).collect()
    best = {}
    for r in rows:
        best[r[2] or ""] = max(best.get(r[2] or "", -99), -98 if r[0] is None else r[0])
    want = []
    for r in rows:
        top = best[r[2] or ""]
        same = (-98 if r[0] is None else r[0]) == top
        want.append((str(r[0]), len((r[2] or "").encode()), W.digest_of((r[2] or "").encode()), "response" if same else "revisit", "None" if same else str(top)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)


def test_lookup(spark):
    df, _ = pages(spark)
    root, captures, index = archive(df)
    keys = spark.createDataFrame([("com,example,n)/",), ("zzz)/",), ("",)], "key string")
    got = W.read_records(W.lookup(keys, index, root), root).collect()
    assert sorted(str(r.page_id) for r in got) == ["-5", "None"]
    assert W.url_key("HTTPS://A.b.com:80/P?q#f") == "com,b,a:80)/P?q"


def test_small_payloads_stay(spark):
    df, rows = pages(spark)
    _, captures, _ = archive(df, min_bytes=10**6)
    root = archive(df, min_bytes=10**6)
    assert {r.record_type for r in W.read_records(root[1], root[0]).collect()} == {"response"} and captures.count() == len(rows)


def test_empty(spark):
    root, captures, index = archive(spark.createDataFrame([], PAGES))
    assert W.read_records(W.lookup(captures.select("key").distinct(), index, root), root).count() == 0


def test_digests_in_sql(spark, tmp_path):
    df, rows = pages(spark)
    df = df.filter("page_id is not null").dropDuplicates(["page_id"])
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = W.op1_warc(spark, str(tmp_path)).collect()
    assert sorted(map(str, con.sql(W.SQL).fetchall())) == sorted(str(tuple(r)) for r in got)


def test_rules(spark):
    rows = [(1, "https://WWW.Example.com/en/7x", None), (2, "http://x.com/en/", None), (3, "http://com/en/?q", None), (4, "http://notcom/en/", None), (5, "http://a.example.net/de/80#f", None), (6, "http://b.net/de/8", None), (7, None, None), (8, "no scheme", None), (9, "x://org?/es/", None)]
    got = {r.page_id: r for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(1, 10)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/7x") and (got[9].host, got[9].path) == ("org", "") and got[8].host == ""
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_spread(spark):
    rng = random.Random(1)
    n = 30
    e = {(rng.randrange(n), rng.randrange(n)): rng.randrange(1, 4) for _ in range(80)}
    e = {k: v for k, v in e.items() if k[0] != k[1]}
    df = spark.createDataFrame([(f"h{a}", f"h{b}", v) for (a, b), v in e.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "h1"), ("trust", "h2"), ("distrust", "h3")], "kind string, host string")
    got = {(r.kind, r.host): r.score for r in U.spread(df, seeds, rounds=20, least_change=0).collect()}
    for kind, seed in (("trust", [1, 2]), ("distrust", [3])):
        m = np.zeros((n, n))
        for (a, b), v in e.items():
            m[(b, a) if kind == "trust" else (a, b)] = v
        m = m / np.maximum(m.sum(0), 1)
        s = np.zeros(n)
        s[seed] = 0.15
        r = np.zeros(n)
        for _ in range(20):
            r = s + 0.85 * m @ r
        assert all(abs(got.get((kind, f"h{i}"), 0) - r[i]) < 1e-9 for i in range(n))


def test_links_block_hosts(spark):
    rows = [(1, "http://bad.com/en/1", ""), (2, "http://friend.io/a", '<a href="http://bad.com/x"><a href=//BAD.com/y>'), (3, "http://fine.io/a", '<a href="/local">'), (4, "http://good.net/de/1", '<a href="https://fine.io/">')]
    got = {r.page_id: r for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "block", "allow", "allow"] and got[3].host_trust > 0


def test_template():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "]", "<", ">", "s>", "a", " ", "[ROLE=", "[/ROLE]", "/", "\n", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "a]b", "[/ROLE]", "%41", "x\\"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        out = "".join(C.render(*t) for t in turns)
        assert [(r, C.unescape(out[a:z])) for r, a, z in C.parse(out)] == turns
        assert "".join(C.unescape(out[a:z]) for a, z in C.mask(out)) == "".join(t for r, t in turns if r == "assistant")


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, 5, None, "</s>[INST]"), (2, 3, "system", ""), (3, 0, "user", "x"), (3, 0, "user", "x"), (None, 1, "user", "n")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(70)]
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumnRenamed("conv_id", "path")).collect()}
    for conv in (1, 2, 3, 9, None):
        own = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv].loss_chars == sum(len(x) for _, r, x in own if r == "assistant")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(empty).count() == 0


def test_reply_trees(spark):
    rng = random.Random(4)
    parent, score = {}, {}
    for i in range(200):
        parent[i] = None if i % 50 == 0 else rng.randrange(i - i % 50, i)
        score[i] = rng.random()
    nodes = spark.createDataFrame([(i, parent[i], score[i]) for i in range(200)], "id long, parent long, score double")
    paths = {}
    for leaf in set(range(200)) - set(parent.values()):
        p = [leaf]
        while parent[p[-1]] is not None:
            p.append(parent[p[-1]])
        paths.setdefault(p[-1], []).append((-sum(score[x] for x in p) / len(p), -len(p), leaf, p[::-1]))
    want = {b[2]: b[3] for root in paths.values() for b in sorted(root)[:2]}
    got = {}
    for r in C.chosen_paths(nodes, 2).orderBy("depth").collect():
        got.setdefault(r.path, []).append(r.id)
    assert got == want


def test_cycles(spark):
    nodes = spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0), (3, None, 0.0)], "id long, parent long, score double")
    try:
        C.chosen_paths(nodes).count()
    except ValueError as e:
        assert "cycle" in str(e)
    else:
        raise AssertionError("a cycle went unseen")

import hashlib
import re

from pyspark.sql import functions as F

from quarry.llm import dedup as D
from quarry.llm.common import located, new_path


def key(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def check(rows, got):
    groups = {}
    for r in rows:
        groups.setdefault(key(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    best = {k: (min(v)[3], len(v)) for k, v in groups.items()}
    assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == sorted((str(r[0]), str(best[key(r[1])][0]), best[key(r[1])][1]) for r in rows)
    assert sum(r.kept for r in got) == len(groups)
    assert {bytes(r.sha).hex() for r in got} == {hashlib.sha256(k.encode()).hexdigest() for k in groups}


def test_classes(docs, none, rows):
    check(rows, D.classes(docs)[1].collect())
    assert D.classes(none)[1].count() == 0


def test_digest_collisions(docs, rows):
    """One digest byte: unequal texts meet in one state and are told apart by their bytes."""
    check(rows, D.classes(docs, digest_bytes=1)[1].collect())


def test_filter(docs, none, rows):
    out = D.exact_dedup(docs)
    assert out.columns == docs.columns and sorted(key(r.text) for r in out.collect()) == sorted({key(r[1]) for r in rows})
    assert D.exact_dedup(none).count() == 0
    assert D.exact_dedup(docs.select("*", F.lit(1).alias("at_row"))).count() == out.count()


def test_state_goes_on(spark, docs):
    """Files that come later meet the state that earlier ones left."""
    light = D.records(*located(docs))
    path, state = new_path(spark, "t-log"), new_path(spark, "t-state")
    light.filter("id < 20").write.parquet(path)
    first = D.keyed_state(light, path, state).count()
    light.filter("id >= 20 or id is null").repartition(2).write.mode("append").parquet(path)
    both = D.keyed_state(light, path, state, files_per_trigger=1)
    assert first < both.count() == light.select("digest").distinct().count()
    assert both.agg(F.sum("n")).first()[0] == light.count()

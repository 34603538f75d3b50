import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, at_file int, sketch string"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty, blank, long, equal and similar texts, repeated rows and ids."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(30)]
    texts = [*base, base[0], base[1].replace(" ", "\n"), base[2] + " tail", "Z" + base[2], base[3].upper(), None, "", " \t\n", "é ü 漢字 " * 30, prose(rng, 9000, 50), "short one", "ab " * 200, "x\ny\nx\ny\n" + base[4], "# $ % & | < > " * 20 + base[5]]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(4)]
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x", i, None) for i, t in enumerate(texts)]
    return [*out, out[5], out[0], (None, base[6], None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None), (7, base[8], "en", "s0", 1, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(40)] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)

"""Registered queries over the driver's tables, each with DuckDB SQL where SQL expresses it.

``documents`` stand for files (rel_path = source/doc_id.md), ``embeddings`` for chunk vectors, ``benchmark`` for labelled queries.
Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import relevance as R
from quarry.functions import secrets, synonyms, text
from quarry.operators import chunk, context, evaluate, fusion, keyword, vector
from quarry.plans import indexing
from quarry.plans.store import Store, shared_root
from quarry.sources.embedders import HashEmbedder, embedded
from quarry.sources.files import table_sources
from quarry.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}

PATH = "source || '/' || doc_id || '.md'"
FILES = f"files as (select {PATH} as rel_path, coalesce(text, '') as content, doc_id, lang, n_chars from documents)"
WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda w: strlen(w) < 40)"
LINES = r"case when content = '' then []::varchar[] else string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n') end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files_of(spark, d) -> DataFrame:
    return table_sources(read(spark, d, "documents"))


def doc_files(spark, d) -> DataFrame:
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return read(spark, d, "documents").select("doc_id", path.alias("rel_path"), F.coalesce("text", F.lit("")).alias("content"), "lang", "n_chars")


# -- chunks and identity -----------------------------------------------------


@query(
    rf"""with {FILES}, l as (select rel_path, {LINES} as ls from files),
    c as (select rel_path, ls, len(ls) as n, unnest(range(0, (((greatest(len(ls) - 8, 0) + 4) // 5) * 5 + 1)::bigint, 5)) as start from l where len(ls) > 0),
    d as (select rel_path, (start // 5)::int as ordinal, (start + 1)::int as start_line, least(start + 8, n)::int as end_line, array_to_string(list_slice(ls, start + 1, least(start + 8, n)), chr(10)) as content from c)
    select rel_path, ordinal, start_line, end_line, sha256(content) as content_hash, sha256(rel_path || ':chunk_' || ordinal || ':' || sha256(content)) as id from d"""
)
def chunk_sliding_docs(spark, d):
    """Windows of 8 lines, step 5, of all documents, with their identity."""
    c = chunk.sliding_chunks(files_of(spark, d), window=8, step=5)
    h = text.content_hash("content")
    return c.select("rel_path", "ordinal", "start_line", "end_line", h.alias("content_hash"), text.chunk_id("rel_path", F.lit(None).cast("string"), "ordinal", h).alias("id"))


@query(
    rf"""with {FILES}, l as (select rel_path, {LINES} as ls from files),
    c as (select rel_path, ls, len(ls) as n, unnest(range(0, (((greatest(len(ls) - 40, 0) + 23) // 24) * 24 + 1)::bigint, 24)) as start from l where len(ls) > 0)
    select rel_path, count(*) as chunks, sum(least(start + 40, n) - start)::bigint as lines from c group by rel_path"""
)
def chunk_document_windows(spark, d):
    """The production windows for documents: 40 lines, 40 % overlap."""
    c = chunk.sliding_chunks(files_of(spark, d))
    return c.groupBy("rel_path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))


@query(
    rf"""with {FILES}, l as (select rel_path, {LINES} as ls from files),
    p as (select rel_path, 'path: ' || rel_path || chr(10) || coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: i <= 50 or i > len(ls) - 20 or
      regexp_matches(regexp_replace(ls[i], '^\s+', ''), '^({"|".join(text.DECLARATIONS)})')), lambda i: ls[i] || chr(10)), ''), '') as t from l)
    select rel_path, length(t) as chars, sha256('shallow:' || rel_path || ':' || sha256(t)) as id from p"""
)
def shallow_projection(spark, d):
    s = chunk.shallow_documents(files_of(spark, d))
    return s.select("rel_path", F.length("content").cast("long").alias("chars"), "id")


@query(f"with {FILES} select rel_path, strlen(content)::bigint as bytes, ceil(strlen(content) / 4.8)::bigint as md_tokens, ceil(strlen(content) / 3.5::double)::bigint as py_tokens, ceil(strlen(content) / 3.8::double)::bigint as other_tokens from files")
def token_estimate(spark, d):
    f = files_of(spark, d)
    t = lambda lang: text.token_estimate("content", F.lit(lang))
    return f.select("rel_path", F.octet_length("content").cast("long").alias("bytes"), t("md").alias("md_tokens"), t("python").alias("py_tokens"), t("?").alias("other_tokens"))


@query(f"with {FILES} select rel_path, substr(sha256(content), 1, 16) as file_hash, sha256(content) as content_hash, split_part(rel_path, '/', 1) as prefix, doc_id || '.md' as name, doc_id::varchar as stem, 'md' as ext, true as is_doc, split_part(rel_path, '/', 1) = 'src0' as in_src0 from files")
def path_and_hash(spark, d):
    f = files_of(spark, d)
    return f.select(
        "rel_path", text.file_hash(F.col("content").cast("binary")).alias("file_hash"), text.content_hash("content").alias("content_hash"), text.directory("rel_path").alias("prefix"), text.file_name("rel_path").alias("name"),
        text.stem("rel_path").alias("stem"), text.extension("rel_path").alias("ext"), text.is_doc_path("rel_path").alias("is_doc"), text.in_scope("rel_path", "src0").alias("in_src0"),
    )


_quoted = lambda x: x.replace("'", "''")
BY_RULE = f"regexp_matches(content, '{_quoted('|'.join(secrets.RULES))}')"
ASSIGNED = f"regexp_extract_all(content, '{_quoted(secrets.ASSIGNED)}', 1)"
BITS = """list_sum(list_transform(list_distinct(string_split({v}, '')), lambda x:
    -(len(list_filter(string_split({v}, ''), lambda y: y = x)) / length({v})::double) * log2(len(list_filter(string_split({v}, ''), lambda y: y = x)) / length({v})::double)))"""


@query(f"with {FILES} select rel_path, {BY_RULE} as by_rule, len({ASSIGNED})::int as assignments from files")
def secret_scan(spark, d):
    f = files_of(spark, d)
    return f.select("rel_path", secrets.matches_rule("content").alias("by_rule"), F.size(secrets.assigned_values("content")).alias("assignments"))


@query(f"with {FILES} select rel_path from files where not {BY_RULE} and len(list_filter({ASSIGNED}, lambda v: {BITS.format(v='v')} >= {secrets.LEAST_ENTROPY})) = 0")
def secret_gate(spark, d):
    """Documents that pass both secret gates."""
    return files_of(spark, d).filter(~secrets.skip_file("rel_path") & ~secrets.contains_secret("content")).select("rel_path")


@query(f"select p_partkey, round({BITS.format(v='p_name')}, 9) as bits from part")
def text_entropy(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(secrets.entropy("p_name"), 9).alias("bits"))


# Paths of code files, which the tables lack, made from part numbers.
_EXTENSIONS = ["rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "md", "txt", "RS", "unknown"]
_LANGUAGE = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "go": "go"}
_EXT_SQL = f"{_EXTENSIONS}[1 + (p_partkey % {len(_EXTENSIONS)})::int]"


@query(
    f"""with p as (select p_partkey, case p_partkey % 3 when 0 then 'Docs' when 1 then 'src/docs' else 'lib' end || '/f' || p_partkey || '.' || {_EXT_SQL} as path, lower({_EXT_SQL}) as ext from part)
    select p_partkey, path, case ext {" ".join(f"when '{k}' then '{v}'" for k, v in _LANGUAGE.items())} when 'md' then {{md}} when 'java' then {{java}} when 'txt' then {{txt}} end as language,
    ext, p_partkey % 3 != 2 or ext in ('md', 'txt', 'rst', 'adoc') as is_doc from p""".format(**{k: "null" if text.LANGUAGES.get(k) is None else f"'{text.LANGUAGES[k]}'" for k in ("md", "java", "txt")})
)
def path_language(spark, d):
    """Language, extension and kind of paths given with back slashes."""
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (1 + F.col("p_partkey") % len(_EXTENSIONS)).cast("int"))
    box = F.when(F.col("p_partkey") % 3 == 0, "Docs").when(F.col("p_partkey") % 3 == 1, "src\\docs").otherwise("lib")
    p = read(spark, d, "part").select("p_partkey", text.normal_path(F.concat(box, F.lit("\\f"), "p_partkey", F.lit("."), ext)).alias("path"))
    return p.select("p_partkey", "path", text.language_of("path").alias("language"), text.extension("path").alias("ext"), text.is_doc_path("path").alias("is_doc"))


# -- vectors -----------------------------------------------------------------

L2 = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2])::double * (z[1] - z[2])::double))::float"


@query(f"select vec_id, distance, label from (select e.vec_id, e.label, {L2.format('e.embedding', 'q.embedding')} as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q) order by distance, vec_id limit 10")
def knn_exact(spark, d):
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return vector.search_vector(e, list(q), 10, vector="embedding", id_col="vec_id").select("vec_id", "distance", "label")


@query(f"select vec_id, distance, label from (select e.vec_id, e.label, {L2.format('e.embedding', 'q.embedding')} as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.label = 3) order by distance, vec_id limit 10")
def knn_filtered(spark, d):
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return vector.search_vector(e, list(q), 10, filters=F.col("label") == 3, vector="embedding", id_col="vec_id").select("vec_id", "distance", "label")


@query(
    f"""with p as (select q.vec_id as query_id, e.vec_id as id, {L2.format('e.embedding', 'q.embedding')} as distance from embeddings e, embeddings q where q.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by distance, id) as rank from p) select query_id, id, round(distance::double, 4) as distance, rank::int as rank from r where rank <= 8"""
)
def knn_batch(spark, d):
    """The stated query set, every vector whose id is divisible by 20, against all vectors."""
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.search_vectors(e, q, 8, vector="embedding", id_col="vec_id").withColumn("distance", F.round(F.col("distance").cast("double"), 4))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x * 3::float) as v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x::double * x::double))) as n from v)
    select vec_id, round((v[1] / n)::float::double, 5) as first_, round((v[len(v)] / n)::float::double, 5) as last_, len(v)::int as dim from n""")
def vector_norms(spark, d):
    """Vectors of another length brought back to unit norm."""
    v = read(spark, d, "embeddings").select("vec_id", R.l2_normalised(F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))).alias("v"))
    each = lambda i: F.round(F.element_at("v", i).cast("double"), 5)
    return v.select("vec_id", each(1).alias("first_"), each(-1).alias("last_"), F.size("v").alias("dim"))


@query(f"select e.vec_id, round(1 / (1 + greatest({L2.format('e.embedding', 'q.embedding')}::double, 0)), 5) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q")
def vector_similarity(spark, d):
    """Similarity from the distance to one vector."""
    e = read(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)).cast("float") for x in e.filter("vec_id = 0").first()["embedding"]])
    return e.select("vec_id", F.round(R.similarity(R.squared_l2("embedding", q)).cast("double"), 5).alias("similarity"))


# -- keyword search ----------------------------------------------------------

BM25 = rf"""tok as (select doc_id as id, unnest({WORDS.format("text")}) as term from documents),
    len_ as (select id, count(*) as n from tok group by id), tf as (select id, term, count(*) as tf from tok group by id, term), df as (select term, count(*) as df from tf group by term),
    st as (select (select count(*) from documents) as docs, (select sum(n) from len_)::double / (select count(*) from documents) as avg_len),
    sc as (select query_id, tf.id, round(sum(qt.weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) as score
           from qt join tf using (term) join df using (term) join len_ on len_.id = tf.id, st group by query_id, tf.id),
    rk as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc)"""
ITEMS = rf"it as (select item_id as query_id, unnest({WORDS.format('text')}) as term from benchmark), qt as (select query_id, term, count(*) as weight from it group by query_id, term)"


def _docs(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("").alias("symbol_name"))


def _bm25(spark, d, terms) -> DataFrame:
    index = keyword.build_index(_docs(spark, d), stem=False, positions=False, terms=keyword.analysed(terms, False))
    scored = keyword.score(index, terms, stem=False, phrases=False)
    return scored.withColumn("score", F.round("score", 6))


def _item_terms(spark, d) -> DataFrame:
    b = read(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(keyword.words_of("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


@query(f"with {ITEMS}, {BM25} select query_id, id, score, rank::int as rank from rk where rank <= 10")
def bm25_topk(spark, d):
    return keyword.top_k(_bm25(spark, d, _item_terms(spark, d)), 10)


EXPANDED = "with recursive s(term, w) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in synonyms.SYNONYMS.items()) + ")"


@query(
    EXPANDED
    + rf""", uq as (select conv_id * 1000 + turn as query_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) as token from conversations where role = 'user'),
    ex as (select query_id, unnest(coalesce(string_split(w, ' '), [token])) as term from uq left join s on s.term = uq.token) select query_id, term, count(*) as weight from ex group by query_id, term"""
)
def synonym_terms(spark, d):
    """Expanded query terms of every user turn, with multiplicity."""
    q = read(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return synonyms.query_terms(q)


@query()
def bm25_stemmed(spark, d):
    """Stemmed search with phrases: every benchmark passage against all documents."""
    terms = _item_terms(spark, d)
    index = keyword.build_index(_docs(spark, d), terms=keyword.analysed(terms, True))
    # Rounded before the cut: sums differ in their last bits with the order of addition, and equal documents must tie by id.
    return keyword.top_k(keyword.score(index, terms).withColumn("score", F.round("score", 6)), 10)


@query(f"with {ITEMS}, {BM25}, kept as (select *, row_number() over (partition by query_id order by score desc, id) as k from sc where id in (select doc_id from documents where source = 'src0')) select query_id, id, score, k::int as rank from kept where k <= 10")
def bm25_filtered(spark, d):
    """A filter on the documents' columns holds before the cut: ten results each, though other documents score better."""
    terms = _item_terms(spark, d)
    docs = doc_files(spark, d).select(F.col("doc_id").alias("id"), "rel_path", "content", F.lit("").alias("symbol_name"))
    index = keyword.build_index(docs, stem=False, positions=False, terms=keyword.analysed(terms, False))
    scored = keyword.score(index, terms, stem=False, phrases=False).withColumn("score", F.round("score", 6))
    return keyword.best_of(scored, index["docs"], 10, text.in_scope("rel_path", "src0"))


@query(
    EXPANDED
    + rf""", uq as (select conv_id * 1000 + turn as query_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) as token from conversations where role = 'user'),
    ex as (select query_id, unnest(coalesce(string_split(w, ' '), [token])) as term from uq left join s on s.term = uq.token), qt as (select query_id, term, count(*) as weight from ex group by query_id, term),
    {BM25} select query_id, id, score, rank::int as rank from rk where rank <= 5"""
)
def bm25_expanded(spark, d):
    """The keyword leg: every user turn with its synonyms against all documents."""
    terms = synonym_terms(spark, d)
    index = keyword.build_index(_docs(spark, d), stem=False, positions=False, terms=keyword.analysed(terms, False))
    return keyword.top_words(index, terms, 5, stem=False)


@query(f"with {ITEMS.split(', qt')[0]}, {BM25.split('len_ as')[0].rstrip().rstrip(',')} select term, count(distinct id) as df, count(*) as cf from tok group by term")
def term_statistics(spark, d):
    p = keyword.build_index(_docs(spark, d), stem=False, positions=False)["postings"].filter("field = 'content'")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


# -- fusion ------------------------------------------------------------------

#: A search hands at most so many candidates to fusion and assembly.
CANDIDATES = 1000
RANKED = f"""s as (select 0 as query_id, doc_id as id, row_number() over (order by n_chars, doc_id)::int as rank from documents where lang = 'en' order by 3 limit {CANDIDATES}),
    k as (select 0 as query_id, doc_id as id, row_number() over (order by n_chars desc, doc_id)::int as rank from documents where source != 'src1' order by 3 limit {CANDIDATES})"""


def _ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two rankings of documents by length: English ones ascending, those outside of src1 descending."""
    docs = read(spark, d, "documents")
    semantic = docs.filter("lang = 'en'").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("float").alias("distance"))
    kw = docs.filter("source != 'src1'").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return keyword.top_k(semantic, CANDIDATES, "distance", ascending=True), keyword.top_k(kw, CANDIDATES)


@query(f"with {RANKED} select coalesce(s.id, k.id) as id, (coalesce(0.6::float / (60 + s.rank), 0::float) + coalesce(0.4::float / (60 + k.rank), 0::float))::float as score from s full join k on s.id = k.id")
def rrf_full_outer(spark, d):
    s, k = _ranked(spark, d)
    return fusion.rrf_fuse(s, k).select("id", "score")


@query(
    f"""with {RANKED}, f as (select coalesce(s.id, k.id) as id, (coalesce(0.6::float / (60 + s.rank), 0::float) + coalesce(0.4::float / (60 + k.rank), 0::float))::float as score from s full join k on s.id = k.id),
    r as (select *, row_number() over (order by score desc, id)::int as rank from f) select r.id, score, rank, {PATH} as rel_path from r join documents on doc_id = r.id where rank <= 50"""
)
def hybrid_hydrated(spark, d):
    s, k = _ranked(spark, d)
    c = doc_files(spark, d).select(F.col("doc_id").alias("id"), "rel_path", "content")
    return fusion.hydrate(fusion.fused_top_k(s, k, 50), c).select("id", "score", "rank", "rel_path")


@query(
    rf"""with {ITEMS}, {BM25}, dist as (select item_id as query_id, e.vec_id as id, {L2.format('e.embedding', 'q.embedding')} as distance from benchmark join embeddings q on q.vec_id = item_id, embeddings e),
    s as (select query_id, id, row_number() over (partition by query_id order by distance, id) as rank from dist qualify rank <= 40), k as (select query_id, id, rank from rk where rank <= 40),
    f as (select coalesce(s.query_id, k.query_id) as query_id, coalesce(s.id, k.id) as id, (coalesce((0.7::float / (60 + s.rank))::float, 0::float) + coalesce((0.3::float / (60 + k.rank))::float, 0::float))::float as score
          from s full join k on s.query_id = k.query_id and s.id = k.id),
    r as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from f)
    select query_id, r.id, rank, round(score::double, 6) as score, {PATH} as rel_path from r join documents on doc_id = r.id where rank <= 10"""
)
def hybrid_search(spark, d):
    """Both legs of every benchmark passage, fused by weights of its words and hydrated: vectors of equal numbers stand for the
    passages' and the documents' vectors."""
    b, e = read(spark, d, "benchmark"), read(spark, d, "embeddings")
    q = b.join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    semantic = vector.search_vectors(e, q, R.candidate_limit(10), vector="embedding", id_col="vec_id")
    kw = keyword.top_k(_bm25(spark, d, _item_terms(spark, d)), R.candidate_limit(10))
    ranked = fusion.fused_top_k(semantic, kw, 10, fusion.query_weights(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))))
    c = doc_files(spark, d).select(F.col("doc_id").alias("id"), "rel_path", "content")
    return fusion.hydrate(ranked, c).select("query_id", "id", "rank", F.round(F.col("score").cast("double"), 6).alias("score"), "rel_path")


def _fallback(spark, d) -> DataFrame:
    """Ranked documents hydrated where the chunk table lacks every third one and the keyword index every second."""
    f = doc_files(spark, d).withColumnRenamed("doc_id", "id").select("id", "rel_path", "content", F.lit("markdown").alias("language"), F.col("n_chars").alias("last_modified"))
    copies = f.filter("id % 2 = 0").withColumn("content", F.concat(F.lit("copy: "), "content"))
    return fusion.hydrate(_ranked(spark, d)[1].select("id", "rank"), f.filter("id % 3 != 0"), copies)


@query(f"with {RANKED} select k.id, k.rank from k where id % 3 = 0 and id % 2 = 0")
def anti_missing(spark, d):
    """Ranked ids that the chunk table lacks and the keyword index's copy serves."""
    return _fallback(spark, d).filter("content like 'copy: %' and last_modified = 0").select("id", "rank")


@query(f"with {RANKED} select k.id, k.rank, {PATH} as rel_path, (length(coalesce(text, '')) + case when k.id % 3 = 0 then 6 else 0 end)::int as chars from k join documents on doc_id = k.id where k.id % 3 != 0 or k.id % 2 = 0")
def hydrate_left(spark, d):
    return _fallback(spark, d).select("id", "rank", "rel_path", F.length("content").alias("chars"))


@query("select doc_id from documents semi join (select doc_id from labels where quality = 1) using (doc_id) where source = 'src0'")
def semi_scope(spark, d):
    f = doc_files(spark, d).filter(text.in_scope("rel_path", "src0"))
    return f.join(read(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


TOK = r"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.]+'), lambda t: regexp_replace(t, '^\.+|\.+$', '', 'g')), lambda t: t != '')"


@query(
    rf"""with q as (select conv_id, turn, {TOK} as t from conversations),
    i as (select conv_id, turn, len(t)::int as tokens, len(list_filter(t, lambda x: (regexp_matches(x, '^[A-Za-z0-9]+(_[A-Za-z0-9]+)+$') and regexp_matches(x, '[A-Za-z]')) or regexp_matches(x, '^[A-Za-z0-9]*[a-z][A-Z][A-Za-z0-9]*$')
      or (regexp_matches(x, '^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)+$') and regexp_matches(x, '[A-Za-z]')) or regexp_matches(x, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*[A-Z][A-Z0-9_]*s?$')))::int as identifiers from q)
    select conv_id, turn, tokens, identifiers, case when tokens > 0 and identifiers::double / tokens > 0.6 then 0.4::float when tokens > 0 and identifiers::double / tokens < 0.25 then 0.7::float else 0.6::float end as w_semantic from i"""
)
def adaptive_weights(spark, d):
    c = read(spark, d, "conversations")
    t = R.query_tokens("text")
    return c.select("conv_id", "turn", F.size(t).alias("tokens"), F.size(F.filter(t, R.is_identifier)).alias("identifiers"), R.adaptive_weights("text")[0].alias("w_semantic"))


# -- context -----------------------------------------------------------------

RESULTS = f"res as (select 0 as query_id, doc_id as id, {PATH} as rel_path, n_chars::float as score, row_number() over (order by n_chars desc, doc_id)::int as rank from documents order by rank limit {CANDIDATES})"


def _results(spark, d) -> DataFrame:
    f = doc_files(spark, d).select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), "rel_path", F.col("n_chars").cast("float").alias("score"))
    return keyword.top_k(f, CANDIDATES)


@query(f"with {RESULTS}, n as (select *, (score / max(score) over ())::float as relevance from res) select id, rank, relevance from n where relevance >= 0.05::float")
def normalise_threshold(spark, d):
    return context.filter_results(_results(spark, d), min_relevance=0.05).select("id", "rank", "relevance")


@query(f"with {RESULTS}, x as (select *, split_part(rel_path, '/', 1) as dir from res), f as (select *, min(rank) over (partition by dir) as first_ from x), r as (select *, dense_rank() over (order by first_) as k from f) select id, rank, dir from r where k <= 5")
def max_files_gate(spark, d):
    """All results of the first five directories, in rank order (directories stand for files with several chunks)."""
    r = _results(spark, d).withColumn("rel_path", text.directory("rel_path"))
    return context.first_files(r, 5).select("id", "rank", F.col("rel_path").alias("dir"))


@query(
    f"""with {RESULTS}, g as (select split_part(rel_path, '/', 1) as prefix, count(*) as n, round(avg((score / top)::float), 5) as avg_relevance from res, (select max(score) as top from res) group by 1)
    select * from g where (select count(*) from g) > 2"""
)
def clusters(spark, d):
    r = context.filter_results(_results(spark, d))
    return context.clusters(r).select("prefix", "n", F.round("avg_relevance", 5).alias("avg_relevance"))


@query(
    f"""with {RESULTS}, c as (select rel_path, replace(rel_path, '.md', '') as p from res), x as (select split_part(p, '/', 1) as box, split_part(p, '/', 2) as stem from c),
    h as (select unnest(['tests/test_' || stem || '.md', 'tests/' || stem || '_test.md', 'tests/test_' || box || '.md', 'tests/' || box || '_test.md', 'tests/' || box || '/test_' || stem || '.md', 'tests/' || box || '/' || stem || '_test.md']) as path, 0.6::float as multiplier from x),
    l as (select unnest([box || '/mod.rs', box || '/index.ts', box || '/index.tsx', box || '/index.js', box || '/index.jsx']) as path, 0.4::float from x),
    a as (select * from h union all select * from l) select path, max(multiplier) as multiplier from a where path not in (select rel_path from res) group by path"""
)
def related_paths(spark, d):
    return context.related_paths(_results(spark, d).select("query_id", "rel_path", "rank")).select("path", "multiplier")


@query(
    """select o_orderkey, case when age < 86400 then (s * 1.1::float)::float when age < 604800 then (s * 1.03::float)::float else s end as boosted
    from (select o_orderkey, 0.8::float as s, 901000000 - epoch(o_orderdate)::bigint as age, epoch(o_orderdate)::bigint as m from orders) where m > 0 and age >= 0
    union all select o_orderkey, 0.8::float from orders where epoch(o_orderdate)::bigint <= 0 or 901000000 - epoch(o_orderdate)::bigint < 0"""
)
def recency_boost(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", R.recency(F.lit(0.8).cast("float"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")), 901_000_000).alias("boosted"))


@query(
    f"""with {RESULTS}, n as (select *, (score / max(score) over ())::float as relevance from res) select id, relevance, (select bool_or(relevance < 0.1::float) from n where rel_path like 'src2/%') as threshold_filtered from n
    where rel_path like 'src2/%' and relevance >= 0.1::float"""
)
def package_filter(spark, d):
    """The assembler's own filter: relevance by the best of all results, then scope and threshold."""
    kept, dropped = context.direct_results(_results(spark, d), scope="src2", min_relevance=0.1)
    return kept.join(dropped, "query_id").select("id", "relevance", "threshold_filtered")


@query(
    f"""with {RESULTS}, c as (select vec_id * 10 + j as id, 'tests/test_' || vec_id || '.md' as path, list_transform(embedding, lambda x: (x * (1 + j)::float)::float) as v from embeddings, range(5) t(j)),
    n as (select c.id, c.path, res.rank, {L2.format("c.v", "q.embedding")} as distance from c join res on c.path = 'tests/test_' || regexp_extract(res.rel_path, '([^/.]*)[.]md$', 1) || '.md', (select embedding from embeddings where vec_id = 0) q),
    k as (select *, row_number() over (partition by path order by distance, id) as k, (1 / (1 + greatest(distance, 0)))::float as similarity from n qualify row_number() over (partition by path order by distance, id) <= 3),
    f as (select *, dense_rank() over (order by rank, path) as file_ from k where similarity > 0.3::float)
    select id, path as rel_path, round(similarity::double * 0.6, 5) as relevance from f where file_ <= 5"""
)
def related_chunks(spark, d):
    """Per related test file the nearest three of its chunks, at most five files."""
    e = read(spark, d, "embeddings")
    scaled = F.transform("embedding", lambda x: (x * (1 + F.col("j")).cast("float")).cast("float"))
    c = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).select((F.col("vec_id") * 10 + F.col("j")).alias("id"), F.concat(F.lit("tests/test_"), "vec_id", F.lit(".md")).alias("rel_path"), scaled.alias("vector"))
    q = e.filter("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query_vector"))
    return context.expand_related(_results(spark, d).select("query_id", "rel_path", "rank"), c, q).select("id", "rel_path", F.round(F.col("relevance").cast("double"), 5).alias("relevance"))


def _overlapping(spark, d) -> DataFrame:
    c = chunk.sliding_chunks(files_of(spark, d), window=8, step=3)
    c = c.select(F.lit(0).alias("query_id"), "rel_path", "start_line", "end_line", F.crc32(F.concat_ws(":", "rel_path", "ordinal")).cast("long").alias("id"), (F.pmod(F.crc32(F.concat_ws(":", "rel_path", "ordinal")), F.lit(1000)) / 1000).cast("float").alias("relevance"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "rel_path").orderBy(F.desc("relevance"), "start_line")))


@query(
    rf"""with recursive {FILES}, l as (select rel_path, {LINES} as ls from files),
    w as (select rel_path, len(ls) as n, unnest(range(0, (((greatest(len(ls) - 8, 0) + 2) // 3) * 3 + 1)::bigint, 3)) as start from l where len(ls) > 0),
    c as (select rel_path, (start + 1)::int as a, least(start + 8, n)::int as z, row_number() over (partition by rel_path order by start) as i from w),
    f as (select rel_path, i, a, z, 1 as g from c where i = 1
      union all select c.rel_path, c.i, case when 2 * greatest(least(f.z, c.z) - greatest(f.a, c.a) + 1, 0) > least(f.z - f.a + 1, c.z - c.a + 1) then least(f.a, c.a) else c.a end,
        case when 2 * greatest(least(f.z, c.z) - greatest(f.a, c.a) + 1, 0) > least(f.z - f.a + 1, c.z - c.a + 1) then greatest(f.z, c.z) else c.z end,
        case when 2 * greatest(least(f.z, c.z) - greatest(f.a, c.a) + 1, 0) > least(f.z - f.a + 1, c.z - c.a + 1) then f.g else f.g + 1 end
      from f join c on c.rel_path = f.rel_path and c.i = f.i + 1)
    select rel_path, g::int as part, min(a)::int as start_line, max(z)::int as end_line from f group by rel_path, g"""
)
def dedup_overlap(spark, d):
    """Overlapping windows of every document, merged."""
    m = context.merge_overlaps(_overlapping(spark, d))
    return m.select("rel_path", F.row_number().over(Window.partitionBy("rel_path").orderBy("start_line")).alias("part"), "start_line", "end_line")


@query(
    """with g as (select user_id, count(*) as n, (max(value) / 100)::double as top, count(*) filter (where value >= 50) as above from events group by user_id)
    select user_id, case when n = 0 or top < 0.5 or above < 2 then 'low' when top > 0.8 and above >= 3 then 'high' else 'medium' end as confidence, case when top > 0.8 and n >= 3 then 'high' when top >= 0.5 or n >= 2 then 'medium' else 'low' end as search_confidence,
      case when n % 3 = 0 then 'index_incomplete' when above > 5 then 'threshold_filtered' when n < 12 then 'no_more_relevant' end as gap from g"""
)
def confidence(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max("value") / 100).alias("top"), F.count_if(F.col("value") >= 50).alias("above"))
    status = F.when(F.col("n") % 3 == 0, "partial").otherwise("full")
    return g.select("user_id", context.confidence_of(F.col("n"), F.col("top"), F.col("above")).alias("confidence"), context.search_confidence(F.col("n"), F.col("top")).alias("search_confidence"), context.gap_reason(status, F.col("above") > 5, F.col("n"), F.lit(12)).alias("gap"))


def _package(spark, d) -> tuple[DataFrame, DataFrame]:
    """A package for every benchmark passage from stemmed search over all documents."""
    docs = doc_files(spark, d)
    terms = _item_terms(spark, d)
    index = keyword.build_index(_docs(spark, d), stem=False, positions=False, terms=keyword.analysed(terms, False))
    ranked = keyword.keyword_search(index, terms, 20, stem=False, phrases=False)
    rows = ranked.withColumn("score", F.round("score", 6).cast("float")).join(docs.withColumnRenamed("doc_id", "id"), "id")
    rows = rows.select("query_id", "id", "rel_path", F.lit(1).alias("start_line"), F.size(text.lines_of("content")).alias("end_line"), F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("symbol_type"), F.lit("markdown").alias("language"), "content", F.lit(0).cast("long").alias("last_modified"), "score", "rank")
    return context.assemble(rows, budget=4000, max_files=5, min_relevance=0.2)


@query()
def context_package(spark, d):
    package, meta = _package(spark, d)
    return context.to_wire(package, meta)


@query()
def budget_allocation(spark, d):
    package, _ = _package(spark, d)
    return package.select("query_id", "id", "place", "total_tokens")


# -- indexing ----------------------------------------------------------------

STATE = "st as (select source || '/' || doc_id || '.md' as rel_path, case when doc_id % 7 = 0 then 'old' else substr(sha256(coalesce(text, '')), 1, 16) end as hash, case when doc_id % 5 = 0 then 'failed' else 'indexed' end as status from documents where doc_id % 11 != 0)"


def _state(spark, d) -> tuple[DataFrame, DataFrame]:
    """All documents as files, and an earlier state of them: some hashes old, some runs failed, some files unknown."""
    f = doc_files(spark, d).withColumn("hash", text.file_hash(F.col("content").cast("binary")))
    old = f.filter("doc_id % 11 != 0").select("rel_path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("indexed").alias("status"))
    return f, old


@query(f"with {FILES}, {STATE} select f.rel_path from files f left join st using (rel_path) where st.hash is distinct from substr(sha256(content), 1, 16) or st.status is distinct from 'indexed'")
def change_detection(spark, d):
    f, old = _state(spark, d)
    return indexing.changed_files(f, old).select("rel_path")


@query(
    f"""with {FILES}, {STATE}, c as (select count(*) as total, count(*) filter (where st.hash = substr(sha256(content), 1, 16) and st.status = 'indexed') as indexed from files f left join st using (rel_path))
    select total, indexed, round(indexed / total * 1000) / 10 as pct, case when indexed = 0 then 'empty' when indexed = total then 'full' else 'partial' end as status from c"""
)
def coverage(spark, d):
    return indexing.coverage(*_state(spark, d))


@query("select count(*) as chunks, count(*) filter (where k.h is not null) as reused, count(distinct sha256(text)) filter (where k.h is null) as embedded from documents left join (select distinct sha256(text) as h from documents where source in ('src0', 'src1', 'src2')) k on k.h = sha256(text)")
def embedding_reuse(spark, d):
    """Vectors of three sources' texts are known; equal texts anywhere reuse them, others are embedded once each."""
    docs = read(spark, d, "documents").select("source", F.col("text").alias("content"), text.content_hash("text").alias("content_hash"))
    known = docs.filter(F.col("source").isin("src0", "src1", "src2")).select("content_hash", F.array(F.lit(0.0).cast("float")).alias("vector"))
    p = indexing.plan_reuse(docs, known)
    missing = F.col("vector").isNull()
    return p.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~missing).alias("reused"), F.count_distinct(F.when(missing, F.col("content_hash"))).alias("embedded"))


#: Documents as they are (now_) and as they were: some shorter by a line, some not there yet; and a file that is gone since.
VERSIONS = f"""{FILES}, now_ as (select rel_path, content, doc_id from files), was as (
    select rel_path, case when doc_id % 7 = 0 then content || chr(10) || 'an earlier last line' else content end as content, doc_id from files where doc_id % 11 != 0)"""
NO_SECRET = f"not {BY_RULE} and len(list_filter({ASSIGNED}, lambda v: {BITS.format(v='v')} >= {secrets.LEAST_ENTROPY})) = 0"


def _windows(files: str) -> str:
    """SQL for the production windows of ``files`` without those that hold secrets."""
    return rf"""(select * from (select rel_path, doc_id, start, least(start + 40, n) as end_line, array_to_string(list_slice(ls, start + 1, least(start + 40, n)), chr(10)) as content
      from (select *, len(ls) as n, unnest(range(0, (((greatest(len(ls) - 40, 0) + 23) // 24) * 24 + 1)::bigint, 24)) as start from (select rel_path, doc_id, {LINES} as ls from {files}) where len(ls) > 0)) where {NO_SECRET})"""


def _reindexed(spark, d) -> tuple[Store, dict]:
    """A store that was brought up to the earlier documents and then to the present ones, and the second run's counts."""
    now_ = files_of(spark, d)
    number = F.regexp_extract("rel_path", r"(\d+)\.md$", 1).cast("long")
    was = now_.filter(number % 11 != 0).withColumn("content", F.when(number % 7 == 0, F.concat("content", F.lit("\nan earlier last line"))).otherwise(F.col("content")))
    gone = spark.createDataFrame([("gone/since.md", "a file that is not there any more", 0)], now_.schema)
    e = HashEmbedder(16)
    store = Store.create(spark, shared_root(spark), model=e.name, dim=e.dim)
    indexing.index_files(was.unionByName(gone), store, e, now=1)
    return store, indexing.index_files(now_, store, e, now=2)


@query(
    rf"""with {VERSIONS}, c as {_windows("now_")} select 'chunk' as kind, rel_path, (start + 1) || '-' || end_line || ' ' || sha256(rel_path || ':chunk_' || (start // 24) || ':' || sha256(content)) as fact from c
    union all select 'state', rel_path, substr(sha256(content), 1, 16) || ' indexed ' || case when doc_id % 11 = 0 or doc_id % 7 = 0 then 2 else 1 end from now_"""
)
def incremental_index(spark, d):
    """Chunk and state rows of a store after a second run over changed, new, vanished and unchanged files."""
    store, _ = _reindexed(spark, d)
    chunks = store.chunks.select(F.lit("chunk").alias("kind"), "rel_path", F.concat_ws(" ", text.line_range("start_line", "end_line"), "id").alias("fact"))
    return chunks.unionByName(store.table("state").select(F.lit("state").alias("kind"), "rel_path", F.concat_ws(" ", "hash", "status", "indexed_at").alias("fact")))


@query(
    rf"""with {VERSIONS}, t as (select * from now_ where doc_id % 11 = 0 or doc_id % 7 = 0), c as {_windows("t")}, o as (select * from {_windows("was")} where doc_id % 7 = 0),
    n as (select count(*) as chunks, count(*) filter (where sha256(content) in (select sha256(content) from o)) as reused from c)
    select (select count(*) from now_) as files, (select count(*) from t) as changed, 1::bigint as removed, chunks, reused, chunks - reused as embeddings from n"""
)
def incremental_counts(spark, d):
    """What the second run did: only changed files are chunked, and only chunks whose content they did not have are embedded."""
    _, stats = _reindexed(spark, d)
    names = ["files", "changed", "removed", "chunks", "reused", "embeddings"]
    return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query()
def hashed_embeddings(spark, d):
    """Hash embeddings of all documents, each distinct text once."""
    docs = read(spark, d, "documents").select("doc_id", "text", text.content_hash("text").alias("content_hash"), F.lit(None).cast("array<float>").alias("vector"))
    return indexing.embed_missing(docs, HashEmbedder(64), "text").select("doc_id", F.size("vector").alias("dim"), embedded_norm("vector").alias("norm"))


def embedded_norm(c: str):
    return F.round(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4)


# -- evaluation and streams --------------------------------------------------


@query(
    rf"""with {ITEMS}, {BM25}, rel as (select item_id as query_id, doc_id as id from benchmark b join documents on contains(documents.text, b.text)), n as (select query_id, count(*) as n from rel group by query_id),
    h as (select query_id, count(*) as hits, min(rank) as first_ from rk join rel using (query_id, id) where rank <= 5 group by query_id)
    select query_id, round(coalesce(hits, 0) / 5, 6) as "precision", round(coalesce(hits, 0) / n, 6) as recall, round(coalesce(1 / first_, 0), 6) as reciprocal_rank from n left join h using (query_id)"""
)
def eval_precision_recall_mrr(spark, d):
    """Passages that some document holds, searched over all documents; a stated set of passages meets the texts in one pass."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = doc_files(spark, d)
    ranked = keyword.top_k(_bm25(spark, d, _item_terms(spark, d)), evaluate.CANDIDATES).join(docs.select(F.col("doc_id").alias("id"), "rel_path"), "id")
    relevant = passages_in(docs.select("rel_path", F.col("content").alias("text")), items)
    s = evaluate.score_queries(ranked, relevant)
    return s.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


def passages_in(docs: DataFrame, items: DataFrame, words: int = 4, block: int = 500) -> DataFrame:
    """(query_id, rel_path) where the text holds the item's text.

    A text that holds a passage holds its second to fifth word as whole words, so the hash of these four finds the candidates,
    which are then compared in full.  Passages with fewer words meet the texts in blocks.
    """
    split = F.split("text", r"\s+")
    hashed = lambda w, at: F.xxhash64(F.array_join(F.slice(w, at, words), " "))
    items = items.filter("text is not null").withColumn("w", split)
    long = items.filter(F.size("w") >= words + 2).select("query_id", F.col("text").alias("passage"), hashed(F.col("w"), 2).alias("key"))
    grams = F.when(F.size("w") >= words, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: hashed(F.col("w"), i))))
    found = docs.withColumn("w", split).select("rel_path", F.explode(grams).alias("key")).join(long, "key").select("rel_path", "query_id", "passage")
    out = found.join(docs, "rel_path").filter(F.col("text").contains(F.col("passage"))).select("rel_path", "query_id")
    short = items.filter(F.size("w") < words + 2).select("query_id", "text").collect()  # a stated query set of few words each
    for lo in range(0, len(short), block):
        hits = F.array_compact(F.array(*[F.when(F.col("text").contains(r.text), F.lit(r.query_id)) for r in short[lo : lo + block]]))
        out = out.unionByName(docs.select("rel_path", F.explode(hits).alias("query_id")))
    return out


@query("select user_id, max(ts) as ts, count(*) as n from events group by user_id")
def stream_latest_change(spark, d):
    """The latest event of every user, each user standing for a file."""
    e = read(spark, d, "events")
    last = changes.latest_changes(e.select(F.col("user_id").alias("rel_path"), "ts", "event_id"))
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return last.select(F.col("rel_path").alias("user_id"), "ts").join(n, "user_id")


@query(
    """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as new_ from events),
    g as (select user_id, ts, sum(new_) over (partition by user_id order by ts rows unbounded preceding) as k from o) select user_id, max(ts) as ts, count(*) as n from g group by user_id, k"""
)
def debounced_changes(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("rel_path"), "ts")
    return changes.quiet_periods(e, "6 hours").withColumnRenamed("rel_path", "user_id")

"""Query expansion by code-concept synonyms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import _c

# A term and what it is expanded to.
SYNONYMS = {
    "auth": "auth authentication authorize authorization login session token jwt bearer oauth",
    "db": "db database query sql migration schema table",
    "api": "api endpoint route handler controller request response",
    "config": "config configuration settings options env environment",
    "cache": "cache cached memoize memoization lru ttl",
    "queue": "queue enqueue dequeue broker consumer producer",
    "worker": "worker background task job executor thread",
    "job": "job task work scheduler cron background",
    "error": "error err exception failure fault panic",
    "log": "log logs logging trace debug warn error",
    "test": "test tests testing spec case assert",
    "mock": "mock stub fake double fixture spy",
    "fixture": "fixture sample seed setup testdata mock",
    "migration": "migration migrate schema ddl upgrade version",
    "schema": "schema model table field column contract",
    "model": "model entity record struct schema dto",
    "service": "service manager client provider component facade",
    "controller": "controller handler route endpoint action",
    "handler": "handler callback listener controller route",
    "route": "route router endpoint path url handler",
    "middleware": "middleware filter interceptor guard layer",
    "request": "request req input payload body params",
    "response": "response res reply output payload body",
    "token": "token jwt bearer credential secret auth",
    "session": "session cookie login state auth user",
    "user": "user account profile principal identity",
    "permission": "permission access acl policy authorization",
    "role": "role group permission grant scope",
    "validation": "validation validate validator check verify",
    "parser": "parser parse lexer tokenizer syntax",
    "serializer": "serializer serialize encoder marshal json",
    "deserializer": "deserializer deserialize decoder unmarshal json",
    "cli": "cli command terminal shell arg flag",
    "command": "command cmd cli subcommand action",
    "flag": "flag option arg argument switch",
    "env": "env environment variable dotenv config",
    "file": "file path source document blob",
    "path": "path filepath filename route location",
    "async": "async await future promise concurrent",
    "thread": "thread worker concurrency parallel task",
    "lock": "lock mutex rwlock guard synchronize",
    "retry": "retry retries backoff attempt resilience",
    "timeout": "timeout deadline duration expire cancel",
    "rate_limit": "rate_limit ratelimit throttle quota limit",
    "pagination": "pagination page cursor offset limit",
    "search": "search find query lookup retrieve",
    "index": "index indices catalog inverted lookup",
    "vector": "vector embedding dense ann similarity",
    "embedding": "embedding embed vector semantic encoder",
    "chunk": "chunk segment slice span section",
}


def tokens(query: str) -> list[str]:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return re.findall(r"[a-z0-9_]+", "".join(c.lower() if c.isascii() else " " for c in query))


def synonyms_for(term: str, table: dict[str, str] | None = None) -> list[str] | None:
    words = (SYNONYMS if table is None else table).get(term.lower() if term.isascii() else term)
    return words.split() if words else None


def expand(query: str, table: dict[str, str] | None = None) -> str:
    """The boolean form: ``(a OR b) OR c``."""
    return " OR ".join(f"({' OR '.join(s)})" if (s := synonyms_for(t, table)) else t for t in tokens(query))


def synonym_table(spark: SparkSession, table: dict[str, str] | None = None) -> DataFrame:
    """(term, pos, synonym): a fixed small table."""
    rows = [(t, i, s) for t, words in (SYNONYMS if table is None else table).items() for i, s in enumerate(words.split())]
    return spark.createDataFrame(rows, "term string, pos int, synonym string")


def query_terms(queries: DataFrame, expanded: bool = True) -> DataFrame:
    """(query_id, term, weight): terms of queries (query_id, query), weighted by how often expansion yields them."""
    low = F.translate(_c("query"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = queries.select("query_id", F.explode(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0)).alias("token"))
    if expanded:
        table = F.broadcast(synonym_table(queries.sparkSession).groupBy(F.col("term").alias("token")).agg(F.collect_list("synonym").alias("s")))  # 50 rows
        words = words.join(table, "token", "left").select("query_id", F.explode(F.coalesce("s", F.array("token"))).alias("token"))
    return words.groupBy("query_id", F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("weight"))

"""A corpus from ``documents``: quality rules, exact dedup, near dedup, mixing, packing.

Every stage works on all rows its predecessor kept.  The first four return the columns of documents, whatever their
names; the last one returns the pieces' places in sequences, a row per piece: doc_id, piece, start, length,
ids_crc32, sequence_id, offset, and file and row, which tell the copies apart that the mix makes of one document.  Ids
are not carried along: they are the tokens [start, start + length) of the document.

Defined results: documents with a null or empty text have no words and go with the quality rules, very long ones pass whole;
of equal or near-equal documents one row stays, as the operators' docstrings say for ties and for null or repeated ids;
the mix takes words, not documents, as its measure; an empty table passes every stage and gives an empty result.

A stage's rows are made when its caller writes them, so the stages leave the session with Arrow batches of at most BATCH_ROWS
rows (``spark.sql.execution.arrow.maxRecordsPerBatch``); this changes no result.
"""

from __future__ import annotations

from quarry.llm import dedup, minhash, mixing, packing, quality
from quarry.llm.common import few_rows, table, written

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality.quality_filter(few_rows(docs), table(spark, sf_dir, "labels"))),
    ("exact dedup", lambda spark, docs, sf_dir: dedup.exact_dedup(few_rows(docs))),
    ("near dedup", lambda spark, docs, sf_dir: minhash.near_dedup(few_rows(docs), percent=80)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mix_documents(few_rows(docs))),
    ("packing", lambda spark, docs, sf_dir: packing.pack_documents(few_rows(docs), keep_place=True)),
]

#: Quality model, stream state and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs

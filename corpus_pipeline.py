"""The corpus pipeline: STAGES over documents, each stage's rows written and read again before the next.

language_id drops texts that are null, empty, without a letter or in no known language; near_dup leaves one document of each
group and one row of each doc_id (rows without a doc_id all stay); secrets puts a mark in the place of each span; mixing
takes documents at rates of at most one, so clean ones stay; byte_bpe gives token counts and digests instead of the text.
Equal scores and repeated rows are treated alike; an empty table passes all stages; columns of any name are carried along,
but for those that have the name of an output of the last stage."""

from __future__ import annotations

from docloom.llm import byte_bpe, byte_cnn, mixing, near_dup, secrets
from docloom.llm.common import materialize, table

STAGES = [
    ("language_id", byte_cnn.stage),
    ("near_dup", near_dup.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: Networks, signatures and tokenizers aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs

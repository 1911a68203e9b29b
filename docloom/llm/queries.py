"""The queries of this folder, by name."""

from __future__ import annotations

from . import byte_bpe, byte_cnn, flac, mixing, near_dup, pivot_index, prefix_free, secrets, sharding, word_cnn
from .oracles import ORACLES


def queries():
    return {
        "op1_prefix_free": prefix_free.query,
        "op2_toxicity": word_cnn.query,
        "op3_flac": flac.query,
        "op4_sharding": sharding.query,
        "op5_byte_bpe": byte_bpe.query,
        "op6_near_dup": near_dup.query,
        "op7_pivot_index": pivot_index.query,
        "op8_secrets": secrets.query,
        "op9_mixing": mixing.query,
        "op10_language_id": byte_cnn.query,
    }


def oracle_sql():
    return dict(ORACLES)

"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, embeddings, langid, minhash, mixing, pii, quality, secrets, suffixes, toxicity

QUERIES = {
    "op1_suffixes": suffixes.op1_suffixes,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_bpe": bpe.op3_bpe,
    "op4_secrets": secrets.op4_secrets,
    "op5_minhash": minhash.op5_minhash,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_langid": langid.op8_langid,
    "op9_pii": pii.op9_pii,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op10_mixing": mixing.ORACLE,
}

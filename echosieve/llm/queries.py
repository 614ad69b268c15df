"""Queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from echosieve.llm import codes, manifest
from echosieve.llm.bpe import op5_bpe
from echosieve.llm.codes import op13_codes
from echosieve.llm.decontaminate import op10_decontaminate
from echosieve.llm.embeddings import op1_embeddings
from echosieve.llm.hmm import op9_hmm
from echosieve.llm.langid import op2_langid
from echosieve.llm.manifest import op11_manifest
from echosieve.llm.minhash import op7_minhash
from echosieve.llm.pii import op12_pii
from echosieve.llm.quality import op3_quality
from echosieve.llm.suffix import op4_suffix
from echosieve.llm.urls import op6_urls
from echosieve.llm.warc import op8_warc

QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_langid": op2_langid,
    "op3_quality": op3_quality,
    "op4_suffix": op4_suffix,
    "op5_bpe": op5_bpe,
    "op6_urls": op6_urls,
    "op7_minhash": op7_minhash,
    "op8_warc": op8_warc,
    "op9_hmm": op9_hmm,
    "op10_decontaminate": op10_decontaminate,
    "op11_manifest": op11_manifest,
    "op12_pii": op12_pii,
    "op13_codes": op13_codes,
}

ORACLE_SQL: dict[str, str] = {"op11_manifest": manifest.ORACLE, "op13_codes": codes.ORACLE}

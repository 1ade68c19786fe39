"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from loomgraph.llm import bpe, decontaminate, imatch, langid, licenses, quality, simhash, spandedup, tokencount, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_byte_bpe,
        langid.op2_language_id,
        licenses.op3_license_scans,
        quality.op4_quality_classifier,
        tokencount.op5_token_counts,
        toxicity.op6_toxicity,
        simhash.op7_simhash,
        decontaminate.op8_benchmark_decontamination,
        spandedup.op9_suffix_array_dedup,
        imatch.op10_document_fingerprints,
    )
}
#: None of the ten can be said in the other engine's SQL at this scale; each is tested against brute force, an exact
#: round trip or held-out accuracy in tests/llm.
ORACLE_SQL: dict[str, str] = {}

"""Queries and SQL of the subpackage, by name."""

from __future__ import annotations

from strandgraph.llm import ann, audit, chat, jaccard, langid, licences, packing, quality, secrets_crf, tokenfile, wordbpe, wrapper


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_langid": langid.query,
        "op2_html": wrapper.query,
        "op3_ann": ann.query,
        "op4_quality": quality.query,
        "op5_jaccard": jaccard.query,
        "op6_licences": licences.query,
        "op7_bpe": wordbpe.query,
        "op8_secrets": secrets_crf.query,
        "op9_packing": packing.query,
        "op10_chat": chat.query,
        "op11_filter_audit": audit.query,
        "op12_token_file": tokenfile.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {"op6_licences": licences.SQL, "op10_chat": chat.SQL, "op11_filter_audit": audit.SQL}

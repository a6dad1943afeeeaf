"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from quarrel.llm import audio, decontaminate, html_text, minhash, pieces, quality, repeats, secrets, token_counts, token_file


def pipeline(spark, sf_dir: str):
    """The corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_repeats": repeats.op2_repeats,
    "op3_secrets": secrets.op3_secrets,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_token_file": token_file.op5_token_file,
    "op6_audio": audio.op6_audio,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_minhash": minhash.op8_minhash,
    "op9_pieces": pieces.op9_pieces,
    "op10_html": html_text.op10_html,
    "pipeline": pipeline,
}

#: The other queries can't be put in SQL; the tests hold them against brute force, round trips and held-out accuracy.
ORACLES = {
    "op2_repeats": repeats.ORACLE,
    "op3_secrets": secrets.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_minhash": minhash.ORACLE,
}

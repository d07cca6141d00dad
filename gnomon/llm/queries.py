"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_cnn, chat, collocations, fingerprints, id_codec, langid, mixing, ngram_join, pieces, pii, quality, spelling, token_counts

QUERIES = {
    "op1_pareto_mix": mixing.op1_pareto_mix,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_preference_format": chat.op4_preference_format,
    "op5_personal_data": pii.op5_personal_data,
    "op6_weighted_fingerprints": fingerprints.op6_weighted_fingerprints,
    "op7_id_files": id_codec.op7_id_files,
    "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
    "op9_language_mixture": langid.op9_language_mixture,
    "op10_quality_divergence": quality.op10_quality_divergence,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_collocations": collocations.op12_collocations,
    "op13_byte_cnn": byte_cnn.op13_byte_cnn,
}

ORACLE_SQL = {
    "op1_pareto_mix": mixing.ORACLE_SQL,
    "op4_preference_format": chat.ORACLE_SQL,
}

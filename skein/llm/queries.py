"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from skein.llm import audio, bpe, licenses, lines, mixing, neardup, packing, phrases, quality, quotes, substrings, topk, whitening

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_minhash_near_dedup": neardup.query,
    "op3_audio_features": audio.query,
    "op4_mix_sources": mixing.query,
    "op5_exact_top_k": topk.query,
    "op6_line_dedup": lines.query,
    "op7_packing": packing.query,
    "op8_substring_dedup": substrings.query,
    "op9_license_scan": licenses.query,
    "op10_quotation_linking": quotes.query,
    "op11_bpe": bpe.query,
    "op12_phrase_collocations": phrases.query,
    "op13_embedding_whitening": whitening.query,
}

#: The others are held against brute force in tests/llm.
SQL = {
    "op4_mix_sources": mixing.SQL,
    "op5_exact_top_k": topk.SQL,
    "op6_line_dedup": lines.SQL,
    "op8_substring_dedup": substrings.SQL,
    "op9_license_scan": licenses.SQL,
    "op10_quotation_linking": quotes.SQL,
    "op12_phrase_collocations": phrases.SQL,
}

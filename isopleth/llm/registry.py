"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import ann, bpe, chat, idfile, lexical, mixing, neardup, packing, pii, rules, scorers, spelling

QUERIES = {
    "op1_quality": scorers.op1_quality,
    "op2_ngram_jaccard": neardup.op2_ngram_jaccard,
    "op3_bpe": bpe.op3_bpe,
    "op4_rules": rules.op4_rules,
    "op5_toxicity": scorers.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_mixing": mixing.op7_mixing,
    "op8_id_files": idfile.op8_id_files,
    "op9_ann": ann.op9_ann,
    "op10_chat": chat.op10_chat,
    "op11_spelling": spelling.op11_spelling,
    "op12_search": lexical.op12_search,
    "op13_packing": packing.op13_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": neardup.oracle(),
    "op4_rules": rules.oracle(),
    "op10_chat": chat.oracle(),
    "op11_spelling": spelling.oracle(),
    "op12_search": lexical.oracle(),
}

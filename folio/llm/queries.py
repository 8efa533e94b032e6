"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from folio.llm.bagminhash import op5_bagminhash
from folio.llm.fingerprint import op6_fingerprint
from folio.llm.html_tree import op9_html_tree
from folio.llm.packing import op4_packing
from folio.llm.quality_crf import op10_quality_crf
from folio.llm.quality_rules import op1_quality_rules
from folio.llm.secret_scan import op2_secret_scan
from folio.llm.sentencepiece_codec import op8_sentencepiece
from folio.llm.suffix_dedup import op3_suffix_dedup
from folio.llm import importance_resampling, lexical_search, line_dedup, warc
from folio.llm.importance_resampling import op13_importance_resampling
from folio.llm.lexical_search import op12_lexical_search
from folio.llm.line_dedup import op11_line_dedup
from folio.llm.warc import op7_warc

QUERIES = {
    q.__name__: q
    for q in (
        op1_quality_rules, op2_secret_scan, op3_suffix_dedup, op4_packing, op5_bagminhash, op6_fingerprint, op7_warc, op8_sentencepiece, op9_html_tree, op10_quality_crf,
        op11_line_dedup, op12_lexical_search, op13_importance_resampling,
    )
}
#: The others rest on vocabularies, hashes and models beyond SQL; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": warc.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_importance_resampling": importance_resampling.ORACLE,
}

"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tessella.llm.linededup import OP7_SQL, op7_line_dedup
from tessella.llm.minhash import OP10_SQL, op10_near_dedup
from tessella.llm.mixing import op2_mixing
from tessella.llm.packing import op5_packing
from tessella.llm.runs import op11_runs
from tessella.llm.scoring import OP13_SQL, op13_lm_scoring
from tessella.llm.substring import OP3_SQL, op3_substring_dedup
from tessella.llm.suffixes import OP9_SQL, op9_suffix_dedup
from tessella.llm.telephony import op6_telephony
from tessella.llm.toxicity import op4_toxicity
from tessella.llm.vectors import OP8_SQL, op8_top_k
from tessella.llm.warc import OP1_SQL, op1_warc
from tessella.llm.whitening import op12_whitening

QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_telephony": op6_telephony,
    "op7_line_dedup": op7_line_dedup,
    "op8_top_k": op8_top_k,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_runs": op11_runs,
    "op12_whitening": op12_whitening,
    "op13_lm_scoring": op13_lm_scoring,
}
SQL = {
    "op1_warc": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_top_k": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_near_dedup": OP10_SQL,
    "op13_lm_scoring": OP13_SQL,
}

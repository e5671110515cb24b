"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from shelfprice.llm.op01_toxicity import op1_toxicity
from shelfprice.llm.op02_tokens import op2_tokens
from shelfprice.llm.op03_jaccard import OP3_SQL, op3_jaccard
from shelfprice.llm.op04_repeats import op4_repeats
from shelfprice.llm.op05_bpe import op5_bpe
from shelfprice.llm.op06_quality import op6_quality
from shelfprice.llm.op07_search import OP7_SQL, op7_search
from shelfprice.llm.op08_secrets import op8_secrets
from shelfprice.llm.op09_language import op9_language
from shelfprice.llm.op10_decontaminate import OP10_SQL, op10_decontaminate
from shelfprice.llm.op11_lexical import OP11_SQL, op11_lexical
from shelfprice.llm.op12_quality_rules import OP12_SQL, op12_quality_rules
from shelfprice.llm.op13_negatives import OP13_SQL, op13_negatives

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_tokens, op3_jaccard, op4_repeats, op5_bpe, op6_quality, op7_search, op8_secrets, op9_language, op10_decontaminate, op11_lexical, op12_quality_rules, op13_negatives)}
SQL = {"op10_decontaminate": OP10_SQL, "op11_lexical": OP11_SQL, "op3_jaccard": OP3_SQL, "op7_search": OP7_SQL, "op12_quality_rules": OP12_SQL, "op13_negatives": OP13_SQL}

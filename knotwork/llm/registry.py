"""Queries of the subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from knotwork.llm import chat, fim, trie, vptree
from knotwork.llm.chat import op5_chat
from knotwork.llm.decontaminate import op2_decontaminate
from knotwork.llm.fim import op13_fim
from knotwork.llm.licenses import op3_licenses
from knotwork.llm.lines import op8_lines
from knotwork.llm.lm import op11_lm
from knotwork.llm.mixing import op9_mixing
from knotwork.llm.quality import op7_quality
from knotwork.llm.secrets import op4_secrets
from knotwork.llm.simhash import op6_simhash
from knotwork.llm.toxicity import op1_toxicity
from knotwork.llm.trie import op12_trie
from knotwork.llm.vptree import op10_vptree

QUERIES = {q.__name__: q for q in (op1_toxicity, op2_decontaminate, op3_licenses, op4_secrets, op5_chat, op6_simhash, op7_quality, op8_lines, op9_mixing, op10_vptree, op11_lm, op12_trie, op13_fim)}
#: op10 sums in the order of components in both engines; the other operators are trained, hashed or iterative, beyond SQL.
ORACLES: dict[str, str] = {"op5_chat": chat.ORACLE, "op10_vptree": vptree.ORACLE, "op12_trie": trie.ORACLE, "op13_fim": fim.ORACLE}

"""Queries of this subpackage and their SQL."""

from tidemark.llm.decontaminate import op7_decontaminate
from tidemark.llm.exact_dedup import ORACLE as OP3_SQL
from tidemark.llm.exact_dedup import op3_exact_dedup
from tidemark.llm.filter_audit import ORACLE as OP13_SQL
from tidemark.llm.filter_audit import op13_filter_audit
from tidemark.llm.line_dedup import op10_line_dedup
from tidemark.llm.mixing import op5_mix
from tidemark.llm.near_dedup import ORACLE as OP6_SQL
from tidemark.llm.near_dedup import op6_near_dedup
from tidemark.llm.ngram_join import ORACLE as OP11_SQL
from tidemark.llm.ngram_join import op11_ngram_join
from tidemark.llm.parts import ORACLES as PART_SQL
from tidemark.llm.parts import QUERIES as PARTS
from tidemark.llm.quality import op2_quality
from tidemark.llm.secrets import op9_secrets
from tidemark.llm.token_counts import op8_token_counts
from tidemark.llm.toxicity import op1_toxicity
from tidemark.llm.url_filter import op4_url_filter
from tidemark.llm.vector_codes import ORACLE as OP12_SQL
from tidemark.llm.vector_codes import op12_vector_codes

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_exact_dedup, op4_url_filter, op5_mix, op6_near_dedup, op7_decontaminate, op8_token_counts, op9_secrets, op10_line_dedup, op11_ngram_join, op12_vector_codes, op13_filter_audit)} | PARTS
ORACLES = {"op3_exact_dedup": OP3_SQL, "op6_near_dedup": OP6_SQL, "op11_ngram_join": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_filter_audit": OP13_SQL} | PART_SQL

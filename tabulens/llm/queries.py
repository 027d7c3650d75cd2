"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from tabulens.llm.common import table
from tabulens.llm.conversations import repair_conversations
from tabulens.llm.exact_dedup import OP7_SQL, exact_duplicates
from tabulens.llm.mixing import OP1_SQL, mixture
from tabulens.llm.quality import OP4_SQL, judge
from tabulens.llm.near_dedup import near_duplicates
from tabulens.llm.packing import pack
from tabulens.llm.lm import ORDER, score_documents
from tabulens.llm.warc import OP10_SQL, round_trip
from tabulens.llm.toxicity import score_toxicity
from tabulens.llm.line_dedup import OP6_SQL, lines_report
from tabulens.llm.license_scan import OP8_SQL, scan_documents
from tabulens.llm.token_counts import count_tokens
from tabulens.llm.variants import spelling_variants

QUERIES: dict = {
    "op8_license_scan": lambda spark, sf: scan_documents(table(spark, sf, "documents")),
    "op6_line_dedup": lambda spark, sf: lines_report(table(spark, sf, "documents")),
    "op5_toxicity": lambda spark, sf: score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op10_warc": lambda spark, sf: round_trip(spark, table(spark, sf, "pages")),
    "op3_lm_scoring": lambda spark, sf: score_documents(table(spark, sf, "documents"), ORDER),
    "op2_packing": lambda spark, sf: pack(table(spark, sf, "documents")),
    "op9_near_dedup": lambda spark, sf: near_duplicates(table(spark, sf, "documents")),
    "op4_quality": lambda spark, sf: judge(table(spark, sf, "documents")),
    "op1_mixing": lambda spark, sf: mixture(table(spark, sf, "documents")),
    "op7_exact_dedup": lambda spark, sf: exact_duplicates(table(spark, sf, "documents")),
    "op11_spelling_variants": lambda spark, sf: spelling_variants(table(spark, sf, "documents")),
    "op12_conversation_repair": lambda spark, sf: repair_conversations(table(spark, sf, "conversations")),
    "op13_token_counts": lambda spark, sf: count_tokens(table(spark, sf, "documents")),
}

ORACLES: dict[str, str] = {
    "op8_license_scan": OP8_SQL,
    "op6_line_dedup": OP6_SQL,
    "op10_warc": OP10_SQL,
    "op4_quality": OP4_SQL,
    "op1_mixing": OP1_SQL,
    "op7_exact_dedup": OP7_SQL,
}

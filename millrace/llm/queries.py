"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm.alignment import op11_alignment
from millrace.llm.bpe import op6_byte_bpe
from millrace.llm.decontaminate import OP2_SQL, op2_decontamination
from millrace.llm.language import op12_language
from millrace.llm.line_dedup import OP4_SQL, op4_line_dedup
from millrace.llm.mpeg import op1_mpeg_media
from millrace.llm.near_dups import op5_near_dups
from millrace.llm.pii import op8_pii
from millrace.llm.quality import op3_quality
from millrace.llm.sharding import op10_sharding
from millrace.llm.toxicity import op9_toxicity
from millrace.llm.warc import OP7_SQL, op7_warc
from millrace.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_mpeg_media,
        op2_decontamination,
        op3_quality,
        op4_line_dedup,
        op5_near_dups,
        op6_byte_bpe,
        op7_warc,
        op8_pii,
        op9_toxicity,
        op10_sharding,
        op11_alignment,
        op12_language,
        op13_whitening,
    )
}

ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op4_line_dedup": OP4_SQL, "op7_warc": OP7_SQL}

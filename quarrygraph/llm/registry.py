"""The registered queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from . import line_quality, mixing
from .byte_bpe import op10_byte_bpe
from .chat_format import op8_chat_format
from .html_extract import op3_html_extract
from .language_id import op2_language_id
from .near_dedup import op1_near_dedup
from .secret_scan import op5_secret_scan
from .token_files import op4_token_files
from .transport_media import op7_transport_media

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_html_extract": op3_html_extract,
    "op4_token_files": op4_token_files,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": mixing.op6_mixing,
    "op7_transport_media": op7_transport_media,
    "op8_chat_format": op8_chat_format,
    "op9_line_quality": line_quality.op9_line_quality,
    "op10_byte_bpe": op10_byte_bpe,
}
ORACLES = {
    "op6_mixing": mixing.ORACLE,
    "op9_line_quality": line_quality.ORACLE,
}

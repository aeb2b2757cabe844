"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from metaloam.llm import chat_format, decontaminate, quality_rules
from metaloam.llm.chat_format import op1_chat_format
from metaloam.llm.decontaminate import op8_decontaminate
from metaloam.llm.html_extract import op10_html_extract
from metaloam.llm.language_id import op9_language_id
from metaloam.llm.near_dup import op4_near_dup
from metaloam.llm.packing import op5_packing
from metaloam.llm.quality_classifier import op3_quality_classifier
from metaloam.llm.quality_rules import op7_quality_rules
from metaloam.llm.token_files import op2_token_files
from metaloam.llm.url_filter import op6_url_filter

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_token_files": op2_token_files,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_dup": op4_near_dup,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_html_extract": op10_html_extract,
}
SQL = {"op1_chat_format": chat_format.SQL, "op7_quality_rules": quality_rules.SQL, "op8_decontaminate": decontaminate.SQL}

"""The training-data queries and their SQL."""

from __future__ import annotations

from leadloom.llm.decontaminate import op9_decontamination
from leadloom.llm.elias_fano import op10_token_files
from leadloom.llm.language_id import op2_language_id
from leadloom.llm.license_scan import op7_license_scan
from leadloom.llm.media import op6_mpeg_media
from leadloom.llm.packing import op4_best_fit_packing
from leadloom.llm.secrets import op5_secret_scan
from leadloom.llm.simhash import op1_simhash
from leadloom.llm.url_filter import OP3_SQL, op3_url_filter
from leadloom.llm.warc import op8_warc_derivatives

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_mpeg_media": op6_mpeg_media,
    "op7_license_scan": op7_license_scan,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_decontamination": op9_decontamination,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
}

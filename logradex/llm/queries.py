"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from . import bpe, decontam, html, lengths, neardup, pii, quality, secrets, syncmers, urls

QUERIES = {
    "op1_html_extraction": html.op1,
    "op2_url_filter": urls.op2,
    "op3_near_dedup": neardup.op3,
    "op4_syncmers": syncmers.op4,
    "op5_secret_scan": secrets.op5,
    "op6_token_counts": lengths.op6,
    "op7_decontamination": decontam.op7,
    "op8_byte_bpe": bpe.op8,
    "op9_quality": quality.op9,
    "op10_pii": pii.op10,
}

SQL = {
    "op2_url_filter": urls.SQL,
    "op3_near_dedup": neardup.SQL,
}

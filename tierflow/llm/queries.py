"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import decontaminate, html, infill, license, maxent, mixing, pii, quality, resample, sharding, simhash, suffixes, urls

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_license": license.op2_license,
    "op3_simhash": simhash.op3_simhash,
    "op4_sharding": sharding.op4_sharding,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_html": html.op6_html,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_pii": pii.op9_pii,
    "op10_lm": maxent.op10_lm,
    "op11_urls": urls.op11_urls,
    "op12_infill": infill.op12_infill,
    "op13_resample": resample.op13_resample,
}

SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op2_license": license.OP2_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_urls": urls.OP11_SQL,
    "op12_infill": infill.OP12_SQL,
}

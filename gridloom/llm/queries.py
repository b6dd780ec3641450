"""The queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from .bpe import op10_byte_bpe
from .chunks import op7_cdc
from .decontaminate import op6_decontaminate
from .html import op9_html_extract
from .langid import op1_langid
from .ledger import op2_secret_ledger
from .quality import OP4_SQL, op4_quality_rules
from .simhash import op5_simhash
from .suffixes import op8_suffix_array
from .toxicity import op3_toxicity


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (op1_langid, op2_secret_ledger, op3_toxicity, op4_quality_rules, op5_simhash, op6_decontaminate, op7_cdc, op8_suffix_array, op9_html_extract, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL}

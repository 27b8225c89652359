"""All queries of this subpackage by name, with their equivalent SQL."""

from __future__ import annotations

from slidelake.llm.bpe import token_ids
from slidelake.llm.canonical import canonical_found, unmatched
from slidelake.llm.mixing import mix_shares, mixed
from slidelake.llm.truncation import truncated_found, truncation_rates

QUERIES = {
    "p4_found": canonical_found,
    "p4_unmatched": unmatched,
    "p6_ids": token_ids,
    "p7_mix": mixed,
    "p7_shares": mix_shares,
    "p8_found": truncated_found,
    "p8_rates": truncation_rates,
}

ORACLE: dict[str, str] = {}

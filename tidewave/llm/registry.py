"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewave.llm import bitslice, bpe, codes, fingerprints, langid, packing, quality, simhash, spelling, suffixes, token_files, tokengroups, warc

_MODULES = (simhash, warc, bitslice, packing, suffixes, bpe, quality, token_files, fingerprints, langid, codes, spelling, tokengroups)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}

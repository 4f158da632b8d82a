"""Importing this module registers every query of the subpackage."""

from gaugework.llm import column_bwt, compression_bands, credential_links, differencing, edit_leaks, ftrl_quality, hyper_language, jaccard_join, piece_counts, qd_whitening, slack_packing, warc_index, zone_maps  # noqa: F401
from gaugework.llm.registry import ORACLE_SQL, QUERIES  # noqa: F401

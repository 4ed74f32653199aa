"""Imports every operator module, so that all queries are registered."""

from hostlake.llm import alignment, decontaminate, langid, line_dedup, mixing, near_dedup, packing, pieces, quality, resample, secrets, vector_search, warc_zip  # noqa: F401
from hostlake.llm.common import QUERIES, SQL  # noqa: F401

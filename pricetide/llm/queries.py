"""All registered queries of this subpackage."""

from . import byte_bpe, chat_prefixes, factorisation, fill_in_middle, jaccard_join, license_notices, line_frequency, log_bilinear, minimum_cut, spaced_seeds, url_vocabulary, warc_segments, whitening  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

"""Every registered query of the subpackage; importing the operators registers theirs."""

from glasswatch.llm import bpe, chat, decontaminate, langid, lexical, licences, ngramlm, pagediff, quality, repeats, resample, secretscan, simhash  # noqa: F401
from glasswatch.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

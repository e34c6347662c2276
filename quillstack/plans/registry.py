"""All queries of the archive and their SQL."""

from quillstack.plans import reports, texts

ALL = {**reports.QUERIES, **texts.QUERIES}

"""The registered queries of this subpackage, one module per operator.

Each module has ``QUERY`` (name and function of session and folder) and, where SQL
can say it, ``SQL``.
"""

from . import (
    chat_format,
    embedding_dedup,
    fingerprints,
    hidden_markov,
    html_extract,
    jaccard_join,
    language_id,
    mixing,
    packing,
    periodic_runs,
    quality,
    token_output,
    whitening,
)

MODULES = (
    language_id, jaccard_join, hidden_markov, embedding_dedup, token_output, fingerprints, html_extract, mixing, quality, packing,
    whitening, chat_format, periodic_runs,
)


def queries() -> dict:
    return dict(m.QUERY for m in MODULES)


def oracles() -> dict[str, str]:
    return {m.QUERY[0]: m.SQL for m in MODULES if getattr(m, "SQL", None)}

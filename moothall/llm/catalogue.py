"""The queries of this subpackage and the SQL that states their results."""

from moothall.llm import (
    decontaminate, fill_middle, fixity, html_text, jaccard, language, line_runs, mixing, negatives, outliers, substrings, token_counts,
    url_reputation)

MODULES = (url_reputation, token_counts, fixity, line_runs, language, outliers, mixing, html_text, decontaminate, jaccard,
           negatives, fill_middle, substrings)
QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

"""All queries of the core library and their SQL twins."""

from loomline.plans import reference_core, reference_pairs

QUERIES = {**reference_core.QUERIES, **reference_pairs.QUERIES}
SQL = {**reference_core.SQL, **reference_pairs.SQL}

"""The registered queries: library calls over the given tables, each beside the SQL that checks it."""

from workload import cohorts, layouts, sampling, structure

MODULES = (structure, sampling, cohorts, layouts)

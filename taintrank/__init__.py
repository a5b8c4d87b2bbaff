"""taintrank: contamination studies of ranking pipelines as Spark DataFrame jobs.

Subpackages
-----------
sources    readers/writers (triples, JSON score maps, TREC runs, metric tables)
           and the fixtures derived from the driver's tables
functions  native column expressions (text, vectors, statistics)
operators  relational building blocks: joins, reshape, sampling, ranking,
           metrics, losses, retrieval, pluggable scoring, comparisons
plans      end-to-end jobs: contamination build, re-rank, report, distillation
streaming  stateless operators applied to streaming frames
"""

__version__ = "0.1.0"

"""Fall-line analytics on Spark.

Column functions live in :mod:`fallline.functions`, DataFrame-to-DataFrame operators in
:mod:`fallline.operators`, readers and writers in :mod:`fallline.sources`, and whole jobs in
:mod:`fallline.plans`.
"""

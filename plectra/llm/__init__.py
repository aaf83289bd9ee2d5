"""Training-data preparation at corpus scale: ten operators and their queries.

Nothing outside this subpackage (and the pipeline at the repository top) imports it.
"""

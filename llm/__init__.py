"""Training-data pipeline operators (deduplication, quality, privacy, mixing, token output).

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""

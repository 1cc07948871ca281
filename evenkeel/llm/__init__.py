"""Training-data pipeline operators over ``documents`` and ``pages``.

Every operator takes a DataFrame and returns one. Nothing outside this folder,
``corpus_pipeline.py`` and the guarded import in ``__spark_entry__.py`` uses it.
"""

"""Training-data operators: scoring, filtering, deduplication, decontamination, mixing and chat formatting.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it; both may be deleted.
"""

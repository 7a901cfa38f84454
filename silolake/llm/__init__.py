"""Training-data operators: token files, chat formatting, deduplication, toxicity, mixing, WARC, tokenisation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

"""Operators of a large-scale training-data pipeline; nothing else in the library imports them.

``warc`` archives, ``minhash`` near duplicates, ``lm`` masked pseudo-likelihood, ``licenses``
licence paragraphs, ``mixing`` sources to target weights, ``topk`` exact search, ``toxicity``,
``tokenids`` binary token files, ``linededup`` repeated lines, ``decontam`` benchmark leaks.
"""

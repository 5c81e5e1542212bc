"""Operators for training-data pipelines (packing, near-duplicates, token
encoding, archives, fingerprints, language-model and quality scores).

Nothing outside this subpackage imports it.  Modules, by operator:
``packing``, ``simhash``, ``bpe``, ``line_runs``, ``warc``, ``winnow``,
``metric_join``, ``preference``, ``hmm``, ``kernel_quality``; shared parts are
in ``common`` and ``components``; registered queries in ``queries``.
"""

"""Spark operators for speech-transcript and segment datasets.

Every operator is ``DataFrame(s), parameters -> DataFrame`` and every function is
``Column(s), parameters -> Column``; nothing runs until the caller writes or collects.
"""

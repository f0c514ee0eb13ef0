"""Entity analytics on labelled text, built on Spark DataFrames.

Every operator takes and returns a DataFrame with explicit key columns
(``doc_id``, ``pos``, ``run`` ...) and keeps its work on the executors.
"""

__all__ = ["session", "schemas"]

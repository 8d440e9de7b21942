"""sieveworks — document-candidate curation on Spark DataFrames.

Layers:
  functions/  Column-level scalar functions (URL, text, HTML, MinHash)
  sources/    readers: text lists, search payloads, history/index tables
  operators/  DataFrame -> DataFrame operators (dedup, rank, policy, store, views)
  plans/      composed jobs (the curation run) and the query catalog
  streaming/  incremental runs over a file stream
"""

__version__ = "0.1.0"

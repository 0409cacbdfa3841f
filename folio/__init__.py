"""folio: text-corpus, knowledge-base and retrieval jobs on PySpark."""

"""siltstone: curation of code and text corpora as PySpark DataFrame operators."""

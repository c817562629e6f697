"""tessera: DataFrame operators for document corpora and retrieval data."""

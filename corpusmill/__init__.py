"""corpusmill: document retrieval, evaluation and corpus preparation as Spark DataFrame operators."""

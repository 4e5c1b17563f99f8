"""Training-data operators: thirteen Spark jobs over tables of documents and embeddings.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries if it is there.
"""

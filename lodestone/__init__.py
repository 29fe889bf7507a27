"""Lodestone: text retrieval, ranking and classification as Spark DataFrame plans."""

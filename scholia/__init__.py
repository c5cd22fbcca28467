"""scholia: a Spark-first engine for document retrieval, answer checking and corpus analytics."""

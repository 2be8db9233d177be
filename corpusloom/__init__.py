"""corpusloom: document retrieval, question answering and evaluation as Spark DataFrame plans."""

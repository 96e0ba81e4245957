"""quillspark: a knowledge-retrieval engine expressed as Spark DataFrame plans."""

"""Climate similarity and crop suitability as Spark DataFrame operators."""

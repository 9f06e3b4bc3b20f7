"""skeinflow: retrieval, conversation and corpus analytics as Spark DataFrame plans."""

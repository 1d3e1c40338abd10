"""filigree: ranked document retrieval and filing analytics as Spark DataFrame plans."""

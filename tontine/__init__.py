"""Pool-risk analytics for mutual insurance, expressed as Spark DataFrame plans."""

"""larkspan: content-risk analytics expressed as Spark DataFrame plans."""

"""kolophon: textual similarity and clustering as composable Spark DataFrame operators."""

"""Entity-aware retrieval and evaluation over long conversations, as Spark DataFrames."""

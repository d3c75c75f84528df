"""A Spark-first analytics engine for corpora of dialogue transcripts and the market data around them."""

"""tidepool: review-history, text-corpus and training-data analytics as Spark DataFrame operators."""

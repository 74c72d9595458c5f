"""Point-of-sale bookkeeping on Spark: reconcile, classify, report, post and close."""

"""pairlens: a Spark engine for token selection and paired evaluation."""

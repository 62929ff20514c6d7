"""earmark: cautious, reviewable labels from large tables of model scores, as Spark DataFrame operators."""

"""DataFrame-to-DataFrame operators of the evaluation study."""

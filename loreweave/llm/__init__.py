"""Operators for building training data at scale.  Nothing else imports this."""

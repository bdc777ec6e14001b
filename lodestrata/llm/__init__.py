"""Operators for training data of language models; optional, nothing else imports it."""

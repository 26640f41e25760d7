"""Operators for cleaning, selecting and searching training data. Nothing else imports them."""

"""Operators for training data: tokens, personal data, packing, search, joins, pages, quality, chat."""

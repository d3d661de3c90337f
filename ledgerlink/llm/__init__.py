"""Operators for training data: names, record linkage, tokens, packing, text quality. Nothing else imports this."""

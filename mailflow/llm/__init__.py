"""Training-data operators over text, embeddings and mixtures.

Nothing else in the library imports this subpackage.
"""

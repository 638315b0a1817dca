"""Training-data operators over documents, embeddings and web pages."""

"""Operations of training-data pipelines over documents, pages and embeddings."""

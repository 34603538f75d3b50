"""DataFrame operators: chunking, keyword and vector search, fusion, context, evaluation."""

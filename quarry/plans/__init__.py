"""The store, incremental indexing, and the engine's entry points."""

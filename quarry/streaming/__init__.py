"""Change streams that keep a store up to date."""

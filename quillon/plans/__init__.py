"""Search intents, filters and the composed queries."""

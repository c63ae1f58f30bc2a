"""Package part of alertloom."""

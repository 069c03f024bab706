"""The engine's operators; importing this package registers all their queries."""

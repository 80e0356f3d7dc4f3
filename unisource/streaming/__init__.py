"""The stateless operators and the latest-status view over streams."""

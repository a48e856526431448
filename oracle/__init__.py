"""The same results in plain SQL, for checking."""

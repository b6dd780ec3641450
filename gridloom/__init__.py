"""Part of the gridloom engine."""

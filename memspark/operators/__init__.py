"""DataFrame operators over a library, grouped by purpose."""

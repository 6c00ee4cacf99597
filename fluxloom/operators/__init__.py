"""DataFrame -> DataFrame operators over long-format tables."""

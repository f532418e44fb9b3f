"""Message-risk analytics as DataFrame and SQL operations."""

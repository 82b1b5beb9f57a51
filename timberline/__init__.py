"""timberline: relational operators over dated posts, evidence spans and vectors."""

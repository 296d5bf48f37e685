"""The analytics: each module covers one family of operators."""

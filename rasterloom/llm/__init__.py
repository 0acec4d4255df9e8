"""Operators for preparing language-model training corpora; stands alone, nothing else in the library imports it."""

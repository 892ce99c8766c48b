"""Operators for preparing training corpora; nothing else in tideline imports this subpackage."""

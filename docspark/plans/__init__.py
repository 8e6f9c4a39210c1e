"""Derived tables that the registered queries share, as DataFrame plans and as SQL."""

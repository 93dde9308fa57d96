"""Operators for preparing training text: packing, language ID, fingerprints, filters, de-duplication, mixing."""

"""Catalogues of reference data and the composed review plans."""

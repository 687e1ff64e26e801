"""Training-data operators: scanning, deduplication, packing and tokenising at corpus scale.

Nothing else in the library imports this subpackage; ``queries`` lists what it registers.
"""

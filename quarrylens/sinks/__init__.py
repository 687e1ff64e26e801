"""Writers of reports, registers and tables."""

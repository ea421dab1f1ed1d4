"""Whole plans: the scan, the reports and the registered queries."""

"""Readers and writers of variant, region, sequence and alignment text files."""

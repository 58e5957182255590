"""Training-data operators: deduplication, formatting, language ID, decontamination, packing, scoring, scans."""

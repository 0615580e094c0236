"""Training-data operators: mixing, de-duplication, classifiers, packing, scans and extraction at corpus scale."""

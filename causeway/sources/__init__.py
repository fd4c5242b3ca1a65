"""Reading logs: files, raw lines, timestamps, encodings, fingerprints."""

"""Sources: record files, typed text, settings, remote files and the binary format."""

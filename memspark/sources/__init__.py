"""Reading and writing of chunk files, label files and call traces."""

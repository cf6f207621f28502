"""Spark jobs for diffraction image data: frames to peaks, peak banks, patch stores, training pairs and statistics."""

"""Column functions: detector geometry and peak shapes."""

"""Column builders: binning, sequence text, window rules, physical features."""

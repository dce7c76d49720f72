"""Jobs over a stream of arriving interview records."""

"""Training-data operators: text, time and packing problems over transcripts and documents."""

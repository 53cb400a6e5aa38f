"""Data files of the training-data operators: lists of names and words, and the table of look-alikes."""

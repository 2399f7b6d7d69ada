"""Operators on copies and texts for training data: survivors, packing, leaks and look-alikes."""

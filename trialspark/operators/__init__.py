"""Operators: DataFrame -> DataFrame functions, keyed by patient (``alf_pe``)."""

"""Column functions: parsing, fields, classifiers, normalisers, quantiles."""

"""The audits, the feature table and the analyses, composed from the operators."""

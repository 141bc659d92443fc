"""Training-data operators: ten independent operators over text and vector tables."""

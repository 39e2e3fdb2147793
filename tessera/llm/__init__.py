"""Training-data operators: licences, toxicity, decontamination, main text, duplicates, packing, vectors, quality.

Nothing outside this subpackage imports it.  Rows without an id count as one document whose id is above all
others and whose id is returned as null; null texts count as empty.
"""

"""Training-data operators: archives, quality, decontamination, language,
near-duplicates, URL rules, secrets, personal data, page text and mixing.

Nothing else in the library imports this subpackage.
"""

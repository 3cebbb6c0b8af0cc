"""Training-data operators: packing, near copies, classifiers, search, privacy, licences, archives."""

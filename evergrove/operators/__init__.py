"""DataFrame operators: the instance log, collections, templates, visibility."""

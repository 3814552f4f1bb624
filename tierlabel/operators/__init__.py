"""DataFrame operators: table rewrites, grouping, vectors, classifiers, evaluation."""

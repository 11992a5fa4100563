"""DataFrame operators: candidates, ranking, TF-IDF, graphs, iterative scores, evaluation."""

"""Registered queries over the test tables."""


def registered():
    """All queries and their oracle SQL, by name."""
    from playtrail.plans import counting_queries, evaluation_queries, feature_queries, learned_queries, model_queries, shaping_queries, similarity_queries, source_queries  # noqa: F401
    from playtrail.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES

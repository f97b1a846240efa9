"""The five flows: relevance, explore, converge, translate, classify."""

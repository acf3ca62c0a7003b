"""Entity resolution across languages and scripts, and corpus preparation, on PySpark."""

import importlib

_NAMES = {
    "polynym.plans.resolver": ("Resolver",),
    "polynym.operators.cascade": ("Cascade",),
    "polynym.operators.matchers": ("EmbeddingMatcher", "Matcher", "PhoneticMatcher"),
    "polynym.operators.dense": ("Model",),
    "polynym.operators.cluster": ("collect_clusters", "gold_clusters"),
    "polynym.operators.metrics": ("cluster_prf", "confusion", "language_report", "pairwise_prf"),
    "polynym.functions.text": ("normalize_for_matching", "normalize_title", "normalize_unicode", "strip_diacritics"),
    "polynym.functions.script": ("detect_script", "is_same_script"),
    "polynym.functions.translit": ("transliterate_to_latin",),
    "polynym.functions.lexicon": ("read_lexicon",),
    "polynym.sources.entities": ("read_entities",),
}
_PLACES = {name: place for place, names in _NAMES.items() for name in names}
__all__ = list(_PLACES)


def __getattr__(name: str):
    """Exports are loaded when they are asked for, so that Python workers load what they use."""
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(importlib.import_module(_PLACES[name]), name)

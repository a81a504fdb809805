"""Column functions that Spark does not have: accent folding, name keys, log-gamma, Jaro-Winkler similarity."""

from panelkit.functions.numbers import lgamma
from panelkit.functions.strings import fold_accents, jaro_winkler, normalize_name_key

__all__ = ["fold_accents", "jaro_winkler", "lgamma", "normalize_name_key"]

"""papyra: a Spark-native article-corpus and LM-evaluation toolkit.

Every operator is a ``DataFrame -> DataFrame`` function built from the public
PySpark DataFrame API. See README.md for the operator map.
"""

__version__ = "0.1.0"

# The model variants compared by the evaluation step, in their
# declared order (base model first, then the fine-tuned variants).
DEFAULT_MODELS = ("base", "FT_full", "FT-M1B")

DEFAULT_SEED = 42

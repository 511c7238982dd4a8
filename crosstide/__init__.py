"""Cross-sectional time-series signals on Spark.

Names of `crosstide.api` are found here too; it is loaded on first use, so that Python workers, which import modules
of this package, needn't load it.
"""


def __getattr__(name: str):
    import importlib

    if name.startswith("_") and name != "__all__":
        raise AttributeError(name)
    return getattr(importlib.import_module("crosstide.api"), name)

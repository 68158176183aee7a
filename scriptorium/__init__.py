"""scriptorium: text-corpus preparation and evaluation as Spark jobs.

Subpackages
-----------
sources    readers, stand-in mappings and sinks
functions  Column-level helpers (sentence splitting, shares, hash uniforms, arrays)
operators  DataFrame -> DataFrame operators (filters, chunking, ordering, vocabulary,
           encoding, masking, labelled sets, scores, run analytics, Spark ML probes)
plans      end-to-end compositions (corpus build, pretraining feed, fine-tuning eval)
streaming  Structured Streaming variants (incremental chunking, early stopping)
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside UDF closures, so executors
    need no installed copy of the package (works the same on local and cluster)."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older pyspark without the hook
        pass


_ship_by_value()

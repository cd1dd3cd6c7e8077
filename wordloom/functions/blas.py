"""Keep NumPy's BLAS to one thread inside Spark tasks.

Each task already owns one core; a multi-threaded BLAS in every Python
worker oversubscribes the machine by (cores x BLAS threads) and can stall a
job.  ``OPENBLAS_NUM_THREADS=1`` in the executor environment is the first
choice; this helper also applies the limit at run time for sessions created
without it.
"""

from __future__ import annotations

import ctypes
import os

_done = False
_SETTERS = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_",
            "openblas_set_num_threads", "goto_set_num_threads")


def single_thread_blas() -> None:
    global _done
    if _done:
        return
    _done = True
    try:
        import numpy  # noqa: F401  (loads the BLAS library)
        with open("/proc/self/maps") as f:
            libs = {line.split()[-1] for line in f if "openblas" in line.lower() and ".so" in line}
    except OSError:
        return
    for path in libs:
        try:
            lib = ctypes.CDLL(path)
        except OSError:
            continue
        for name in _SETTERS:
            fn = getattr(lib, name, None)
            if fn is not None:
                fn(1)
                break


def pin_environment() -> None:
    """Set the variables before a local JVM (and its Python workers) starts."""
    for var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(var, "1")

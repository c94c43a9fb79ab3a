"""Random Fourier features: an explicit map whose inner products approximate the RBF kernel (Rahimi and Recht, 2007)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

COMPONENTS = 128


def fourier_map(width: int, gamma: float, components: int = COMPONENTS, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2 * gamma), (width, components))
    shift = rng.uniform(0, 2 * np.pi, components)
    scale = np.sqrt(2.0 / components)

    def mapped(x: np.ndarray) -> np.ndarray:
        z = x @ weights
        z += shift
        np.cos(z, out=z)
        z *= scale
        return z

    return mapped


def fourier_features(vector: Column, width: int, gamma: float, components: int = COMPONENTS, seed: int = 42) -> Column:
    """The mapped vector of an ML vector column."""
    mapped = fourier_map(width, gamma, components, seed)

    @F.arrow_udf("array<double>")
    def apply(v: pa.Array) -> pa.Array:
        z = mapped(np.asarray(v.flatten(), np.float64).reshape(len(v), width))
        return pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * np.int32(components), z.ravel())

    return array_to_vector(apply(vector_to_array(vector)))
